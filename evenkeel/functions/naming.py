"""Rules that read a column's meaning from its name.

The suffix letters and substrings are fixed values of the data convention; pass another
``Naming`` to run on tables that follow a different one.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Naming:
    """Column-name convention; the order of ``families`` decides ties."""

    key: str = "case_id"
    outer_ordinal: str = "num_group1"
    inner_ordinal: str = "num_group2"
    decision: str = "date_decision"
    target: str = "target"
    week: str = "WEEK_NUM"
    month: str = "MONTH"
    ordinal_marker: str = "num_group"
    # Suffix letters that carry meaning.
    typed_suffixes: tuple[str, ...] = ("T", "L", "M", "D", "P", "A")
    date_suffix: str = "D"
    # Fixed values: (family, substrings, suffix) tested from top to bottom.
    families: tuple[tuple[str, tuple[str, ...], str], ...] = (
        ("delinquency", ("dpd", "overdue", "pastdue"), "P"),
        (
            "amount",
            (
                "amount", "amt", "annuity", "balance", "cred", "debt",
                "income", "price", "sum", "turnover", "pmtamount",
            ),
            "A",
        ),
        ("count_term", ("num", "cnt", "count", "instl", "term", "month", "year"), "L"),
        ("rate", ("rate", "eir", "interest"), ""),
    )

    @property
    def ordinals(self) -> tuple[str, str]:
        return (self.outer_ordinal, self.inner_ordinal)

    @property
    def reserved(self) -> frozenset[str]:
        """Columns that never become aggregate inputs."""
        return frozenset((self.key, *self.ordinals))

    @property
    def protected(self) -> tuple[str, str, str]:
        """Columns that no selection step may drop."""
        return (self.key, self.target, self.week)

    def is_date(self, name: str) -> bool:
        return name == self.decision or name[-1:] == self.date_suffix

    def is_typed(self, name: str) -> bool:
        """True for columns whose suffix or ordinal marker makes them aggregate inputs."""
        if name in self.reserved:
            return False
        return name[-1:] in self.typed_suffixes or self.ordinal_marker in name

    def family(self, name: str) -> str:
        low = name.lower()
        for family, parts, suffix in self.families:
            if any(part in low for part in parts) or (suffix and name.endswith(suffix)):
                return family
        return "date" if self.is_date(name) else "other"


DEFAULT = Naming()


def split_feature_name(name: str, sep: str = "__") -> tuple[str, str]:
    """(table prefix, aggregate suffix) of a wide-table column."""
    if sep not in name:
        return "base_or_derived", "raw_or_derived"
    return name.split(sep, 1)[0], name.rsplit(sep, 1)[-1]
