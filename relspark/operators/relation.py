"""Keyed relations over DataFrames: lookups, ranges, constraint scans, pages, counts.

A relation is a DataFrame with a primary key, trailing in-key columns that do not count for uniqueness, and
named secondary orderings. Nothing is stored for them: filters reach the scan of the source, and an
index is an order of rows. Results come in index order; what returns a page or a single row sorts no more
than it must (a top-k, not a full sort).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.operators.constraint import Constraint, anything
from relspark.operators.orderer import Orderer, sort_key
from relspark.sources.work import ranked


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


@dataclass(frozen=True)
class RelationDef:
    """Key metadata. An index's columns are its own and then the rest of the primary key without in-key columns."""

    pk: list[str]
    in_key: list[str] = field(default_factory=list)
    secondary: dict[str, list[str]] = field(default_factory=dict)
    computed: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def __post_init__(self):
        if self.in_key and self.pk[-len(self.in_key) :] != self.in_key:
            raise ValueError("in-key columns come last in the primary key")
        if set(self.computed) & set(self.pk):
            raise ValueError("a computed column cannot be part of the primary key")

    @property
    def unique(self) -> list[str]:
        return [c for c in self.pk if c not in self.in_key]

    def index(self, name: str | None = None) -> list[str]:
        if name is None:
            return list(self.pk)
        return self.secondary[name] + [c for c in self.unique if c not in self.secondary[name]]


@dataclass(frozen=True)
class Range:
    """Bounds on the key column after the equality prefix: start is the lower one in either direction."""

    start: object = None
    end: object = None
    start_included: bool = True
    end_included: bool = True
    descending: bool = False

    def on(self, c: Column) -> Column:
        test = F.lit(True)
        if self.start is not None:
            test &= (c >= F.lit(self.start)) if self.start_included else (c > F.lit(self.start))
        if self.end is not None:
            test &= (c <= F.lit(self.end)) if self.end_included else (c < F.lit(self.end))
        return test


class Relation:
    def __init__(self, df: DataFrame, definition: RelationDef):
        self.definition = definition
        self.df = df.withColumns({c: make() for c, make in definition.computed.items()}) if definition.computed else df

    def _order(self, keys: list[str], reverse: bool = False) -> list[Column]:
        return [Orderer(c, reverse).by(self.df) for c in keys]

    def _prefixed(self, prefix: tuple, index: str | None) -> tuple[DataFrame, list[str]]:
        keys = self.definition.index(index)
        if len(prefix) > len(keys):
            raise ValueError(f"{len(prefix)} values for {len(keys)} key columns")
        df = self.df
        for c, v in zip(keys, prefix):
            df = df.where(F.col(c).eqNullSafe(F.lit(v)))
        return df, keys

    # lookups

    def scan(self) -> DataFrame:
        """All rows in primary key order."""
        return self.df.orderBy(*self._order(self.definition.pk))

    def scan_ranked(self, index: str | None = None, to: str = "rn") -> DataFrame:
        """All rows with their place in the index."""
        return ranked(self.df, self._order(self.definition.index(index)), to)

    def find(self, *prefix, index: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows with these leading key values, in index order; columns: of a smaller class."""
        df, keys = self._prefixed(prefix, index)
        df = df.orderBy(*self._order(keys[len(prefix) :])) if len(prefix) < len(keys) else df
        return df.select(*columns) if columns else df

    def find_one(self, *prefix, index: str | None = None, default: bool = False):
        """The only row with these key values; None with default if there is none."""
        rows = self._prefixed(prefix, index)[0].limit(2).collect()
        if len(rows) > 1:
            raise Ambiguous("more than one row has this key")
        if not rows and not default:
            raise NotFound("no row has this key")
        return rows[0] if rows else None

    def contains(self, *prefix, index: str | None = None) -> bool:
        return not self._prefixed(prefix, index)[0].isEmpty()

    def project(self, columns: dict[str, str]) -> DataFrame:
        """Rows as another class: column names to types, cast as try_cast does."""
        return self.df.select(*(F.col(c).try_cast(kind).alias(c) for c, kind in columns.items()))

    # ranges

    def _ranged(self, prefix: tuple, bounds: Range | None, index: str | None) -> tuple[DataFrame, list[str]]:
        df, keys = self._prefixed(prefix, index)
        if bounds:
            if len(prefix) >= len(keys):
                raise ValueError("no key column is left for the range")
            df = df.where(bounds.on(F.col(keys[len(prefix)])))
        return df, keys

    def list(self, *prefix, bounds: Range | None = None, index: str | None = None) -> DataFrame:
        df, keys = self._ranged(prefix, bounds, index)
        return df.orderBy(*self._order(keys, bool(bounds and bounds.descending)))

    def page(self, *prefix, bounds: Range | None = None, index: str | None = None, position: int = 0, count: int = 10) -> DataFrame:
        """Rows from a position of the list on."""
        return self.list(*prefix, bounds=bounds, index=index).offset(position).limit(count)

    def count(self, *prefix, bounds: Range | None = None, index: str | None = None) -> DataFrame:
        return self._ranged(prefix, bounds, index)[0].agg(F.count("*").alias("n"))

    def any(self, *prefix, bounds: Range | None = None, index: str | None = None) -> DataFrame:
        return self._ranged(prefix, bounds, index)[0].limit(1).agg((F.count("*") > 0).alias("found"))

    # constraints

    def _matching(self, constraints: tuple[Constraint, ...], index: str | None, reverse: bool = False) -> tuple[DataFrame, list[str]]:
        keys = self.definition.index(index)
        if len(constraints) > len(keys):
            raise ValueError(f"{len(constraints)} constraints for {len(keys)} key columns")
        df, firsts = self.df, []
        for k, (c, name) in enumerate(zip(constraints, keys)):
            c.check(name, self.df.schema[name].dataType)
            if not c.is_any:
                df = df.where(c.on(F.col(name)))
            if c.first:
                firsts.append(k)
                best = (F.max_by if reverse else F.min_by)(F.struct(name), sort_key(df, [name]))
                least = df.groupBy(*keys[:k]).agg(best.alias("_best")).select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(keys[:k])), F.col(f"_best.{name}").alias("_v"), F.lit(True).alias("_hit"))
                on = F.col(name).eqNullSafe(F.col("_v"))
                for i, p in enumerate(keys[:k]):
                    on &= F.col(p).eqNullSafe(F.col(f"_p{i}"))
                df = df.join(least, on, "left_semi")
        if firsts:
            pick = F.max_by if reverse else F.min_by
            df = df.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(keys[: firsts[0]]))).agg(pick(F.struct(*df.columns), sort_key(df, keys)).alias("_row")).where("_row is not null").select("_row.*")
        return df, keys

    def scan_by(self, *constraints: Constraint, index: str | None = None) -> DataFrame:
        """Rows that meet a constraint on each leading key column, in index order."""
        df, keys = self._matching(constraints, index)
        return df.orderBy(*self._order(keys))

    def _sorted(self, constraints, index, orderers: list[Orderer] | None, reverse: bool = False) -> DataFrame:
        df, keys = self._matching(constraints, index, reverse and not orderers)
        for k, o in enumerate(orderers or []):
            if o.column not in keys:
                raise ValueError(f"orderer {k} names {o.column}, which is not in the index")
        if not orderers:
            return df.orderBy(*self._order(keys, reverse))
        return df.orderBy(*((o.backwards() if reverse else o).by(df) for o in orderers), *self._order(keys))

    def gather(self, skip: int, take: int, *constraints: Constraint, index: str | None = None, orderers: list[Orderer] | None = None) -> DataFrame:
        """A page of the matching rows. A negative skip shortens the page; ties of orderers are in index order."""
        if skip < 0:
            skip, take = 0, take + skip
        return self._sorted(constraints, index, orderers).offset(skip).limit(max(0, take))

    def gather_total(self, *constraints: Constraint, index: str | None = None) -> DataFrame:
        """The number of matching rows, whatever page is taken."""
        return self._matching(constraints, index)[0].agg(F.count("*").alias("total"))

    def first(self, *constraints: Constraint, index: str | None = None, orderers: list[Orderer] | None = None) -> DataFrame:
        return self._sorted(constraints, index, orderers).limit(1)

    def last(self, *constraints: Constraint, index: str | None = None, orderers: list[Orderer] | None = None) -> DataFrame:
        """The last row; with orderers the first of the flipped orderers, so that ties give the least key."""
        return self._sorted(constraints, index, orderers, reverse=True).limit(1)

    def one(self, df: DataFrame, default: bool = False):
        """The row of first() or last(); NotFound if there is none and no default is wanted."""
        row = df.first()
        if row is None and not default:
            raise NotFound("no row matches")
        return row

    # links to other relations

    def dereference(self, columns: str | list[str], target: Relation, prefix: str = "") -> DataFrame:
        """Rows with the columns of the row that columns point to, one for each column of its primary key; null where there is none."""
        columns, keys = [columns] if isinstance(columns, str) else columns, target.definition.unique
        if len(columns) != len(keys):
            raise ValueError(f"{len(columns)} columns for {len(keys)} key columns")
        other = target.df.select(*(F.col(c).alias(f"{prefix}{c}") for c in target.df.columns)).alias("there")
        on = F.lit(True)
        for c, key in zip(columns, keys):
            on &= F.col(f"here.{c}") == F.col(f"there.{prefix}{key}")
        return self.df.alias("here").join(other, on, "left")

    def owned(self, content: DataFrame, own: str, foreign: str) -> DataFrame:
        """Rows with each entry of the dictionary, set or bitmap that they own."""
        return self.df.join(content, F.col(own) == F.col(foreign), "inner")


ANY = anything()
