"""Dataset descriptions: what one side of a comparison holds, and the result
of classifying its columns.

Everything here is driver-side metadata about a schema; nothing touches rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DatasetSpec:
    """One side of a comparison.

    ``features`` are the columns to score; ``id`` and ``datetimes`` are carried
    along but never scored.  ``labels`` optionally maps a physical column name
    to the name it should carry in the result (the "print name").
    """

    features: tuple[str, ...]
    id: str | None = None
    datetimes: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "features", tuple(self.features))
        object.__setattr__(self, "datetimes", tuple(self.datetimes))
        if not self.features:
            raise ValueError("a dataset needs at least one feature column")
        names = self.columns()
        if len(set(names)) != len(names):
            raise ValueError(f"a column appears in more than one role: {names}")
        labels = [self.label(c) for c in names]
        if len(set(labels)) != len(labels):
            raise ValueError(f"labels must be distinct: {labels}")

    def columns(self) -> list[str]:
        """Physical names in role order: id, features, datetimes."""
        return ([self.id] if self.id else []) + list(self.features) + list(self.datetimes)

    def label(self, name: str) -> str:
        return self.labels.get(name, name)

    def labelled(self) -> "DatasetSpec":
        """The same spec expressed in label names (after relabelling)."""
        return DatasetSpec(
            features=tuple(self.label(c) for c in self.features),
            id=self.label(self.id) if self.id else None,
            datetimes=tuple(self.label(c) for c in self.datetimes),
        )


@dataclass(frozen=True)
class DataDefinition:
    """Column roles after classification (what the drift scorer consumes)."""

    id_column: str | None
    numerical: tuple[str, ...]
    categorical: tuple[str, ...]
    datetime: tuple[str, ...]
    other: tuple[str, ...] = ()

    def kind(self, name: str) -> str:
        if name == self.id_column:
            return "id"
        for kind, cols in (("numerical", self.numerical), ("categorical", self.categorical),
                           ("datetime", self.datetime), ("other", self.other)):
            if name in cols:
                return kind
        raise KeyError(name)

    def rows(self) -> list[tuple[str, str]]:
        """(column, kind) pairs, id first, then in definition order."""
        out = [(self.id_column, "id")] if self.id_column else []
        out += [(c, "numerical") for c in self.numerical]
        out += [(c, "categorical") for c in self.categorical]
        out += [(c, "datetime") for c in self.datetime]
        out += [(c, "other") for c in self.other]
        return out
