"""Contracts between filters: what fields each expects, guarantees, or holds only for the length of a route."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError
from ..functions.fieldtypes import TYPES
from ..plans.catalog import REQUIRED, check_name


@dataclass(frozen=True)
class Assertion:
    name: str
    type: str
    expects: bool = False
    guarantees: bool = True
    ephemeral: bool = False

    @property
    def column(self) -> str:
        return self.name


class Contract:
    """Assertions by field. The required fields are in every contract. A signed contract can't be changed, and only signed ones are used."""

    def __init__(self, *assertions: Assertion, sign: bool = False):
        self._by_name = {n: Assertion(n, t, expects=False, guarantees=True) for n, t in REQUIRED}
        self.signed = False
        for a in assertions:
            self.add(a)
        if sign:
            self.sign()

    def add(self, a: Assertion) -> Contract:
        if self.signed:
            raise ContractError("a signed contract can't be changed")
        if a.name in self._by_name:
            raise ContractError(f"the contract has {a.name!r} already")
        if a.type not in TYPES:
            raise ContractError(f"unknown field type {a.type!r}")
        check_name(a.name)
        self._by_name[a.name] = a
        return self

    def sign(self) -> Contract:
        if self.signed:
            raise ContractError("the contract is signed already")
        self.signed = True
        return self

    def __len__(self) -> int:
        return len(self._by_name)

    def __iter__(self) -> Iterator[Assertion]:
        return iter(self._by_name.values())

    def __getitem__(self, name: str) -> Assertion:
        return self._by_name[name]

    def after(self, prior: Contract) -> Contract:
        """The contract of a chain that this one is put at the end of. What it expects must be guaranteed, with the same type."""
        if not (self.signed and prior.signed):
            raise ContractError("only signed contracts can be chained")
        given = {(a.name, a.type) for a in prior if a.guarantees}
        missing = [a.name for a in self if a.expects and (a.name, a.type) not in given]
        if missing:
            raise ContractError(f"nothing guarantees {missing[0]!r}")
        out = Contract()
        out._by_name = {**prior._by_name, **self._by_name}
        return out.sign()

    def unmet(self, columns: set[str], which: str) -> Column:
        """Per row, a message about the first expected (``expects``) or guaranteed (``guarantees``) field that is absent; else null."""
        tests = []
        for a in self:
            if getattr(a, which):
                absent = F.col(a.column).isNull() if a.column in columns else F.lit(True)
                tests.append(F.when(absent, F.lit(f"field {a.name} is not present")))
        return F.coalesce(*tests, F.lit(None).cast("string"))

    def validated(self, df: DataFrame) -> DataFrame:
        """Fields cast to what their types are stored as; values that can't be become null, hence absent."""
        have = set(df.columns)
        casts = {a.column: F.col(a.column).try_cast(TYPES[a.type].storage) for a in self if a.column in have and not (a.type == "datetime")}
        return df.withColumns(casts)


def chain(contracts: list[Contract]) -> Contract:
    """The contract of filters in a row, checked from the first on."""
    return reduce(lambda prior, c: c.after(prior), contracts, Contract(sign=True))
