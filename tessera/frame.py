"""RoleFrame: a lazy DataFrame with a role for each column and, where order matters, a key.

Every method returns a new object over a longer plan; only the ``to_*`` methods, ``values`` and
the likes of ``len`` run a job. NaN is null from the start. Operations that depend on the order
of rows need the frame's ``key`` (one column that orders and identifies rows).
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import errors
from .functions.ranking import position
from .operators import stats
from .roles import BY_TYPE, DefaultRole, FilterRole, InfoRole, Role, StatisticRole, column_roles, matches, python_type
from .storage import Workspace


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


PART_ROWS = 50_000  # rows that a task holds before their groups are reduced


def _reduced(names: list[str], part: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """Of a task's tables what ``part`` keeps of each group's rows; a part that keeps most of them is handed on at once."""

    def reduced(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        return pd.concat([part(own)[list(rows.columns)] for _, own in rows.groupby(names, dropna=False, sort=False, observed=True)])

    def run(tables: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in tables:
            if len(rows):
                held.append(rows)
            if sum(map(len, held)) >= PART_ROWS:
                held = [reduced(held)]
                if len(held[0]) > PART_ROWS // 2:
                    yield held.pop()
        if held:
            yield reduced(held)

    return run


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null; decimals become doubles."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changed[f.name] = F.when(~F.isnan(_quoted(f.name)), _quoted(f.name)).cast("double")
        elif isinstance(f.dataType, T.DecimalType):
            changed[f.name] = _quoted(f.name).cast("double")
    return df.withColumns(changed) if changed else df


class RoleFrame:
    def __init__(self, df: DataFrame, roles: Mapping | None = None, key: str | None = None, _clean: bool = False):
        given = column_roles(roles)
        if missing := set(given) - set(df.columns):
            raise errors.RoleColumnError(f"no such columns: {sorted(missing)}; the table has {df.columns}")
        df = df if _clean else nan_to_null(df)
        for name, role in given.items():
            if role.data_type in BY_TYPE and not _clean:
                df = df.withColumn(name, _quoted(name).try_cast(BY_TYPE[role.data_type]))
        self.df, self.key = df, key
        self.roles: dict[str, Role] = {f.name: given.get(f.name) or DefaultRole(python_type(f.dataType)) for f in df.schema.fields}
        self.roles = {c: r if r.data_type else r.astype(python_type(df.schema[c].dataType)) for c, r in self.roles.items()}

    # construction and conversion
    @classmethod
    def from_dict(cls, spark: SparkSession, data: Mapping[str, Sequence] | Sequence[Mapping], roles: Mapping | None = None, key: str | None = None) -> RoleFrame:
        """From a dict of lists or a list of dicts."""
        return cls(spark.createDataFrame(pd.DataFrame(data)), roles, key)

    @classmethod
    def create_empty(cls, spark: SparkSession, roles: Mapping, key: str | None = None) -> RoleFrame:
        given = column_roles(roles)
        schema = T.StructType([T.StructField(c, BY_TYPE.get(r.data_type, T.StringType())) for c, r in given.items()])
        return cls(spark.createDataFrame([], schema), given, key)

    @classmethod
    def of(cls, spark: SparkSession, data: Any, roles: Mapping | None = None, key: str | None = None) -> RoleFrame:
        """From whatever describes a small table: a frame, dict, list, array or scalar."""
        if isinstance(data, RoleFrame):
            return data
        if isinstance(data, DataFrame):
            return cls(data, roles, key)
        if isinstance(data, Mapping):
            data = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in data.items()}
        elif not isinstance(data, (pd.DataFrame, list)) and not hasattr(data, "shape"):
            data = [data]
        frame = data if isinstance(data, pd.DataFrame) else pd.DataFrame(data)
        frame.columns = [str(c) for c in frame.columns]
        return cls(spark.createDataFrame(frame), roles, key)

    def new(self, df: DataFrame, roles: Mapping[str, Role] | None = None) -> RoleFrame:
        roles = self.roles if roles is None else roles
        return RoleFrame(df, {c: r for c, r in roles.items() if c in df.columns}, self.key if self.key in df.columns else None, _clean=True)

    def to_dict(self) -> dict:
        return {"backend": "spark", "roles": {c: r.name for c, r in self.roles.items()}, "data": self.df.toPandas().to_dict("list")}

    def to_records(self) -> list[dict]:
        return [r.asDict() for r in self.df.collect()]

    def to_numpy(self):
        return self.df.toPandas().to_numpy()

    def to_json(self, path: str | None = None) -> str | None:
        """A JSON string of the columns, or JSON lines written by the executors to ``path``."""
        if path is None:
            return json.dumps(self.df.toPandas().to_dict("list"), default=str)
        self.df.write.mode("overwrite").json(path)
        return None

    # metadata
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def index(self) -> list:
        return self.iget_values(column=self._order())

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def __bool__(self) -> bool:
        return not self.is_empty()

    def search_columns(self, roles, types: Iterable[type] | None = None) -> list[str]:
        types = None if types is None else tuple(types)
        return [c for c, r in self.roles.items() if matches(r, roles) and (types is None or r.data_type in types)]

    def search_columns_by_type(self, types: type | Iterable[type]) -> list[str]:
        types = (types,) if isinstance(types, type) else tuple(types)
        return [c for c, r in self.roles.items() if r.data_type in types]

    def replace_roles(self, changes: Mapping) -> RoleFrame:
        """New roles by column name, or by old role (instance or class)."""
        roles = dict(self.roles)
        for old, role in changes.items():
            role = role() if isinstance(role, type) else role
            for c in [old] if isinstance(old, str) else self.search_columns([old]):
                roles[c] = role if role.data_type else role.astype(roles[c].data_type)
        return self.new(self.df, roles)

    def with_roles(self, roles: Mapping) -> RoleFrame:
        return self.new(self.df, self.roles | column_roles(roles))

    def keyed(self, key: str) -> RoleFrame:
        return RoleFrame(self.df, self.roles, key, _clean=True)

    def _order(self) -> str:
        if self.key is None:
            raise errors.NoRequiredArgumentError("this needs a key column that orders the rows: frame.keyed(column)")
        return self.key

    def _data(self) -> list[str]:
        return [c for c in self.columns if c != self.key]

    def _numeric(self, columns: Sequence[str] | None = None) -> list[str]:
        return [c for c in columns or self._data() if self.roles[c].data_type in (int, float, bool)]

    # selection
    def __getitem__(self, item) -> RoleFrame:
        if isinstance(item, str):
            return self.select([item])
        if isinstance(item, (list, tuple)) and all(isinstance(i, str) for i in item):
            return self.select(list(item))
        if isinstance(item, Column):
            return self.new(self.df.filter(item))
        if isinstance(item, RoleFrame):
            return self.mask(item)
        return self.iloc(item)

    def select(self, columns: Sequence[str]) -> RoleFrame:
        key = [self.key] if self.key and self.key not in columns else []
        return self.new(self.df.select(*[_quoted(c) for c in [*key, *columns]]))

    def mask(self, other: RoleFrame) -> RoleFrame:
        """One mask column filters rows; several blank the cells of the columns of their names."""
        masks = other._data()
        joined, names = self._beside(other)
        if len(masks) == 1:
            return self.new(joined.filter(_quoted(names[masks[0]])).select(*[_quoted(c) for c in self.columns]))
        cells = [F.when(_quoted(names[c]), _quoted(c)).alias(c) if c in masks else _quoted(c) for c in self.columns]
        return self.new(joined.select(*cells))

    def with_column(self, name: str, value: Column | Any, role: Role | None = None) -> RoleFrame:
        value = value if isinstance(value, Column) else F.lit(value)
        df = self.df.withColumn(name, value)
        kind = python_type(df.schema[name].dataType)
        return self.new(df, self.roles | {name: (role or self.roles.get(name) or DefaultRole()).astype(kind)})

    def add_column(self, other: RoleFrame | Column | Any, name: str | None = None, role: Role | None = None) -> RoleFrame:
        """A column from an expression or constant, or columns of another frame with the same key."""
        if isinstance(other, RoleFrame):
            joined, names = self._beside(other)
            kept = [_quoted(c) for c in self.columns] + [_quoted(names[c]).alias(c) for c in other._data()]
            return self.new(joined.select(*kept), self.roles | {c: role or r for c, r in other.roles.items() if c != other.key})
        if name is None:
            raise errors.NoRequiredArgumentError("name")
        return self.with_column(name, other, role)

    def loc(self, keys: Any, columns: Sequence[str] | None = None) -> RoleFrame:
        keys = list(keys) if isinstance(keys, (list, tuple, set)) else [keys]
        rows = self.new(self.df.filter(_quoted(self._order()).isin(keys)))
        return rows if columns is None else rows.select(columns)

    def loc_set(self, keys: Any, column: str, value: Any) -> RoleFrame:
        keys = list(keys) if isinstance(keys, (list, tuple, set)) else [keys]
        kind = self.roles[column].data_type
        if value is not None and kind in BY_TYPE and not isinstance(value, (kind, int) if kind is float else kind):
            raise errors.DataTypeError(f"{column} holds {kind.__name__}, got {type(value).__name__}")
        return self.with_column(column, F.when(_quoted(self._order()).isin(keys), F.lit(value)).otherwise(_quoted(column)))

    def _positioned(self) -> DataFrame:
        return position(self.df, self._order(), "__position")

    def iloc(self, where: int | slice | Sequence[int]) -> RoleFrame:
        """Rows by position in the key's order, from 0."""
        p = F.col("__position") - 1
        if isinstance(where, slice):
            start, stop, step = where.start or 0, where.stop, where.step or 1
            if start < 0 or (stop or 0) < 0 or step < 1:
                raise errors.InvalidArgumentError("positions count from the start")
            cond = (p >= start) & ((p - start) % step == 0)
            cond = cond if stop is None else cond & (p < stop)
        else:
            cond = p.isin([where] if isinstance(where, int) else list(where))
        return self.new(self._positioned().filter(cond).drop("__position"))

    def iloc_set(self, where: int | Sequence[int], column: str, value: Any) -> RoleFrame:
        at = [where] if isinstance(where, int) else list(where)
        cell = F.when((F.col("__position") - 1).isin(at), F.lit(value)).otherwise(_quoted(column))
        return self.new(self._positioned().withColumn(column, cell).drop("__position"))

    def get(self, name: str, default: Any = None) -> Any:
        return self[name] if name in self.columns else default

    def take(self, indices: Sequence[int], axis: int = 0) -> RoleFrame:
        return self.iloc(indices) if axis == 0 else self.select([self._data()[i] for i in indices])

    def get_values(self, row: Any = None, column: str | None = None) -> Any:
        """A cell, a row as a list, or a column in key order."""
        df = self.df if row is None else self.df.filter(_quoted(self._order()) == F.lit(row))
        return self._values(df, row is not None, column)

    def iget_values(self, row: int | None = None, column: str | int | None = None) -> Any:
        column = self._data()[column] if isinstance(column, int) else column
        return self._values(self.df if row is None else self.iloc(row).df, row is not None, column)

    def _values(self, df: DataFrame, one: bool, column: str | None) -> Any:
        df = df.orderBy(_quoted(self.key)) if self.key and not one else df
        rows = [list(r) for r in df.select(*[_quoted(c) for c in ([column] if column else self._data())]).collect()]
        rows = [r[0] for r in rows] if column else rows
        return (rows[0] if rows else None) if one else rows

    def drop(self, columns: str | Sequence[str] | None = None, keys: Sequence | None = None) -> RoleFrame:
        df = self.df
        if columns is not None:
            df = df.drop(*([columns] if isinstance(columns, str) else columns))
        if keys is not None:
            gone = df.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self._order(), df.schema[self.key].dataType)]))
            df = df.join(gone, self.key, "left_anti")
        return self.new(df)

    def filter(self, items: Sequence | None = None, like: str | None = None, regex: str | None = None, axis: int = 1) -> RoleFrame:
        """By label: column names (axis 1) or keys (axis 0)."""
        if axis == 0:
            label = _quoted(self._order()).cast("string")
            cond = label.isin([str(i) for i in items]) if items is not None else label.contains(like) if like is not None else label.rlike(regex)
            return self.new(self.df.filter(cond))
        named = [c for c in self._data() if (c in items if items is not None else like in c if like is not None else re.search(regex, c))]
        return self.select(named)

    def where(self, condition: Column | str) -> RoleFrame:
        return self.new(self.df.filter(condition))

    def select_dtypes(self, include=None, exclude=None) -> RoleFrame:
        as_set = lambda x: set() if x is None else {x} if isinstance(x, type) else set(x)
        include, exclude = as_set(include), as_set(exclude)
        return self.select([c for c in self._data() if (not include or self.roles[c].data_type in include) and self.roles[c].data_type not in exclude])

    def rename(self, names: Mapping[str, str]) -> RoleFrame:
        roles = {names.get(c, c): r for c, r in self.roles.items()}
        return RoleFrame(self.df.withColumnsRenamed(dict(names)), roles, names.get(self.key, self.key), _clean=True)

    def reindex(self, labels: Sequence, fill_value: Any = None) -> RoleFrame:
        key = self._order()
        wanted = self.df.sparkSession.createDataFrame([(v,) for v in labels], T.StructType([T.StructField(key, self.df.schema[key].dataType)]))
        df = wanted.join(self.df.withColumn("__here", F.lit(True)), key, "left")
        if fill_value is not None:
            df = df.withColumns({c: F.when(F.col("__here"), _quoted(c)).otherwise(F.lit(fill_value).try_cast(self.df.schema[c].dataType)) for c in self._data()})
        return self.new(df.select(*[_quoted(c) for c in self.columns]))

    def astype(self, types: Mapping[str, type], errors_: str = "raise") -> RoleFrame:
        """Casts; with errors_="ignore" a column that holds an uncastable value stays as it is."""
        df, roles = self.df, dict(self.roles)
        if errors_ == "ignore":
            fails = [F.count_if(_quoted(c).isNotNull() & _quoted(c).try_cast(BY_TYPE[t]).isNull()).alias(c) for c, t in types.items()]
            bad = df.agg(*fails).first().asDict()
            types = {c: t for c, t in types.items() if not bad[c]}
        for c, t in types.items():
            df, roles[c] = df.withColumn(c, _quoted(c).cast(BY_TYPE[t])), roles[c].astype(t)
        return self.new(df, roles)

    def update_column_type(self, column: str, kind: type) -> RoleFrame:
        """Casts a column that has no null; another stays."""
        return self.astype({column: kind}) if not self.df.filter(_quoted(column).isNull()).head(1) else self

    # element-wise
    def _beside(self, other: RoleFrame) -> tuple[DataFrame, dict[str, str]]:
        """self left-joined to other on the key; names of other's columns in it."""
        if not isinstance(other, RoleFrame):
            raise errors.DataTypeError(f"expected a RoleFrame, got {type(other).__name__}")
        if other.df.sparkSession is not self.df.sparkSession:
            raise errors.BackendTypeError("the frames belong to two sessions")
        names = {c: f"__other_{i}" for i, c in enumerate(other._data())}
        right = other.df.select(_quoted(other._order()).alias("__key"), *[_quoted(c).alias(n) for c, n in names.items()])
        return self.df.join(right, _quoted(self._order()).eqNullSafe(F.col("__key")), "left").drop("__key"), names

    def _each(self, function: Callable[[Column, Column], Column], other: Any = None, role: Role | None = None) -> RoleFrame:
        if isinstance(other, RoleFrame):
            df, names = self._beside(other)
            theirs = [_quoted(n) for n in names.values()]
            theirs = theirs * len(self._data()) if len(theirs) == 1 else theirs
            if len(theirs) != len(self._data()):
                raise errors.DataTypeError("the frames have different numbers of columns")
            pairs = zip(self._data(), theirs, strict=True)
        else:
            df, pairs = self.df, ((c, F.lit(other)) for c in self._data())
        made = {c: function(_quoted(c), o) for c, o in pairs}
        df = df.select(*[made[c].alias(c) if c in made else _quoted(c) for c in self.columns])
        roles = {c: (role or self.roles[c]).astype(python_type(df.schema[c].dataType)) if c in made else self.roles[c] for c in self.columns}
        return self.new(df, roles)

    def isin(self, values: Sequence) -> RoleFrame:
        return self._each(lambda a, _: a.isin(list(values)), role=FilterRole())

    def isna(self) -> RoleFrame:
        return self._each(lambda a, _: a.isNull(), role=FilterRole())

    def log(self) -> RoleFrame:
        return self._each(lambda a, _: F.ln(a))

    def round(self, digits: int = 0) -> RoleFrame:
        """Half to even."""
        return self._each(lambda a, _: F.bround(a, digits))

    def replace(self, old: Any = None, new: Any = None, regex: bool = False) -> RoleFrame:
        """A value, a list or a mapping; with ``regex`` a pattern in string columns."""
        if regex:
            return self._each(lambda a, _: F.regexp_replace(a, old, new))
        pairs = list(old.items()) if isinstance(old, Mapping) else [(o, new) for o in (old if isinstance(old, (list, tuple)) else [old])]

        def swapped(a: Column, _: Column) -> Column:
            out = a
            for o, n in reversed(pairs):
                out = F.when(a.isNull() if o is None else a.eqNullSafe(F.lit(o)), F.lit(n)).otherwise(out)
            return out

        columns = [c for c in self._data() if any(o is None or isinstance(o, self.roles[c].data_type or object) or (self.roles[c].data_type is float and isinstance(o, int)) for o, _ in pairs)]
        part = self.new(self.df.withColumns({c: swapped(_quoted(c), F.lit(None)) for c in columns})) if columns else self
        return part

    def fillna(self, values: Any = None, method: str | None = None) -> RoleFrame:
        """Constants (one, or by column), or the neighbour before (ffill) or after (bfill) in key order."""
        if method is None:
            if values is None:
                raise errors.NoneArgumentError("values or method")
            return self.new(self.df.fillna(values if isinstance(values, Mapping) else values))
        if method not in ("ffill", "bfill"):
            raise errors.InvalidArgumentError(f"method {method!r}")
        return self.new(stats.fill_neighbour(self.df, self._order(), self._data(), method))

    def dropna(self, how: str = "any", subset: Sequence[str] | None = None, axis: int = 0) -> RoleFrame:
        if axis == 0:
            return self.new(self.df.dropna(how, subset=list(subset or self._data())))
        counts = self.df.agg(F.count("*").alias("__n"), *[F.count(_quoted(c)).alias(c) for c in self._data()]).first().asDict()
        n = counts.pop("__n")
        return self.select([c for c, k in counts.items() if (k == n if how == "any" else k > 0)])

    def transpose(self) -> RoleFrame:
        """Small tables only: rows become columns named after the key."""
        return RoleFrame(self.df.transpose(_quoted(self._order())), None, "key")

    def list_to_columns(self, column: str, size: int | None = None) -> RoleFrame:
        size = size or self.df.agg(F.max(F.size(_quoted(column)))).first()[0] or 0
        kept = [c for c in self.columns if c != column]
        parts = [F.get(_quoted(column), i).alias(f"{column}_{i}") for i in range(size)]
        return self.new(self.df.select(*[_quoted(c) for c in kept], *parts))

    def dot(self, matrix: Sequence[Sequence[float]] | RoleFrame, names: Sequence[str] | None = None) -> RoleFrame:
        """Product with a small matrix (rows match our data columns)."""
        if isinstance(matrix, RoleFrame):
            names, matrix = names or matrix._data(), matrix.select(matrix._data()).df.drop(matrix.key or "").toPandas().to_numpy().tolist()
        data = self._data()
        names = names or [f"{i}" for i in range(len(matrix[0]))]
        made = [reduce(operator.add, (_quoted(c) * F.lit(float(matrix[i][j])) for i, c in enumerate(data))).alias(n) for j, n in enumerate(names)]
        key = [_quoted(self.key)] if self.key else []
        return RoleFrame(self.df.select(*key, *made), None, self.key)

    def apply(self, function: Callable, kind: str = "double", axis: int = 0, name: str = "result", role: Role | None = None, most: int = 1_000_000) -> RoleFrame:
        """axis 0: a Series function of each whole column; axis 1: a function of a row, one value a row.

        A function of a whole column needs it in one task, in key order, so the frame may have
        ``most`` rows at most; ``map`` and ``agg`` have no such limit.
        """
        if axis == 0:
            key, data = self._order(), self._data()
            if (rows := self.df.count()) > most:
                raise errors.InvalidArgumentError(f"a function of a whole column takes {most} rows at most, there are {rows}: use map or agg, or raise most")
            fields = T.StructType([self.df.schema[key], *[T.StructField(c, T._parse_datatype_string(kind)) for c in data]])

            def whole(rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values(key, kind="stable")
                return pd.DataFrame({key: rows[key]} | {c: function(rows[c]) for c in data})

            made = self.df.groupBy(F.lit(0).alias("__all")).applyInPandas(whole, fields)
            found = python_type(T._parse_datatype_string(kind))
            return self.new(made, self.roles | {c: (role or self.roles[c]).astype(found) for c in data})
        data = self._data()

        @F.pandas_udf(kind)
        def by_row(rows: pd.DataFrame) -> pd.Series:
            return rows.apply(function, axis=1)

        return self.with_column(name, by_row(F.struct(*[_quoted(c) for c in data])), role)

    def apply_groups(self, by: str | Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, roles: Mapping | None = None, key: str | None = None, most: int = 1_000_000, part: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> RoleFrame:
        """A table function of the rows of each value of ``by``: any rows of the declared ``schema``, with ``roles`` of their own.

        Each group is held by one task, so it may have ``most`` rows at most; null keys are dropped.
        Groups of any size need ``part``: a table function that keeps, of any rows of one group, those
        that ``function`` needs. It runs where the rows are read, over bounded parts, so only what it
        keeps is sent and counted; the values of ``by`` are scalars then.
        """
        names = [by] if isinstance(by, str) else list(by)
        present = self.df.filter(reduce(operator.and_, (_quoted(b).isNotNull() for b in names)))
        if part is not None:
            present = Workspace(self.df.sparkSession, "groups").save(present.mapInPandas(_reduced(names, part), present.schema), "kept")
        largest = present.groupBy(*[_quoted(b) for b in names]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest > most:
            raise errors.InvalidArgumentError(f"a function of a group takes {most} rows at most, there is a group of {largest}: aggregate first, give a part function that keeps less, or raise most")
        return RoleFrame(present.groupBy(*[_quoted(b) for b in names]).applyInPandas(function, schema), roles, key)

    def map(self, function: Callable, kind: str = "double", na_ignore: bool = True) -> RoleFrame:
        def over(values: pd.Series) -> pd.Series:
            return values.map(function, na_action="ignore" if na_ignore else None)

        over.__annotations__ = {"values": pd.Series, "return": pd.Series}
        udf = F.pandas_udf(over, kind)
        return self._each(lambda a, _: udf(a))

    # joins and sets
    def merge(self, right: RoleFrame, on: str | Sequence[str] | None = None, left_on=None, right_on=None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> RoleFrame:
        """Equi-join; without keys the frames' keys are used. Clashing names get the suffixes."""
        if not isinstance(right, RoleFrame):
            raise errors.DataTypeError(f"expected a RoleFrame, got {type(right).__name__}")
        if right.df.sparkSession is not self.df.sparkSession:
            raise errors.BackendTypeError("the frames belong to two sessions")
        as_list = lambda x: [x] if isinstance(x, str) else list(x)
        if how == "cross":
            lefts = rights = []
        else:
            lefts, rights = as_list(on or left_on or self._order()), as_list(on or right_on or right._order())
        for names, frame in ((lefts, self), (rights, right)):
            if missing := set(names) - set(frame.columns):
                raise errors.MergeOnError(f"no such key columns: {sorted(missing)}")
        same = lefts == rights
        clash = {c for c in self.columns if c in right.columns} - (set(lefts) if same else set())
        left_names = {c: c + suffixes[0] if c in clash else c for c in self.columns}
        right_names = {c: c + suffixes[1] if c in clash else c for c in right.columns}
        a = self.df.select(*[_quoted(c).alias(f"__l{i}") for i, c in enumerate(self.columns)])
        b = right.df.select(*[_quoted(c).alias(f"__r{i}") for i, c in enumerate(right.columns)])
        la, rb = {c: F.col(f"__l{i}") for i, c in enumerate(self.columns)}, {c: F.col(f"__r{i}") for i, c in enumerate(right.columns)}
        if how == "cross":
            joined = a.crossJoin(b)
        else:
            joined = a.join(b, reduce(operator.and_, (la[x] == rb[y] for x, y in zip(lefts, rights, strict=True))), "full" if how == "outer" else how)
        out = [(F.coalesce(la[c], rb[c]) if same and c in lefts else la[c]).alias(left_names[c]) for c in self.columns]
        out += [rb[c].alias(right_names[c]) for c in right.columns if not (same and c in rights)]
        roles = {left_names[c]: r for c, r in self.roles.items()} | {right_names[c]: r for c, r in right.roles.items() if not (same and c in rights)}
        return RoleFrame(joined.select(*out), roles, left_names.get(self.key), _clean=True)

    def append(self, *others: RoleFrame, axis: int = 0) -> RoleFrame:
        """axis 0: rows, by name, nulls for missing columns; axis 1: columns, by key, full outer."""
        for o in others:
            if not isinstance(o, RoleFrame):
                raise errors.ConcatDataError(f"expected a RoleFrame, got {type(o).__name__}")
            if o.df.sparkSession is not self.df.sparkSession:
                raise errors.ConcatBackendError("the frames belong to two sessions")
        out = self
        for o in others:
            if axis == 0:
                out = out.new(out.df.unionByName(o.df, allowMissingColumns=True), o.roles | out.roles)
            else:
                renamed = o if o.key == out.key else o.rename({o._order(): out._order()})
                out = out.new(out.df.join(renamed.df, out.key, "full"), renamed.roles | out.roles)
        return out

    # aggregates: one-row frames, see also tessera.operators.stats
    def agg(self, functions: str | Callable | Sequence, columns: Sequence[str] | None = None) -> RoleFrame:
        """Columns <column>_<function> for several functions, <column> for one. Names, or Python functions of a Series (see stats.aggregate_python)."""
        return self._aggregate(self.df, self._numeric(columns), functions)

    def _aggregate(self, df: DataFrame, columns: Sequence[str], functions: str | Callable | Sequence, by: Sequence[str] = ()) -> RoleFrame:
        given = [functions] if isinstance(functions, str) or callable(functions) else list(functions)
        python = [callable(f) for f in given]
        if any(python) and not all(python):
            raise errors.InvalidArgumentError("either names of aggregates or Python functions, not both")
        return self._statistic((stats.aggregate_python if any(python) else stats.aggregate)(df, columns, functions, by))

    def _statistic(self, df: DataFrame) -> RoleFrame:
        return RoleFrame(df, {c: StatisticRole() for c in df.columns}, None, _clean=True)

    def scalar(self) -> float | None:
        """The only cell of a 1 x 1 frame."""
        row = self.df.first()
        if row is None or len(row) != 1:
            raise errors.InvalidArgumentError("not a single cell")
        return None if row[0] is None else float(row[0])

    def count(self) -> RoleFrame:
        return self._statistic(stats.aggregate(self.df, self._data(), "count"))

    def sum(self) -> RoleFrame:
        return self.agg("sum")

    def mean(self) -> RoleFrame:
        return self.agg("mean")

    def min(self) -> RoleFrame:
        return self.agg("min")

    def max(self) -> RoleFrame:
        return self.agg("max")

    def var(self, ddof: int = 1) -> RoleFrame:
        return self.agg("var" if ddof else "var_pop")

    def std(self, ddof: int = 1) -> RoleFrame:
        return self.agg("std" if ddof else "std_pop")

    def coefficient_of_variation(self) -> RoleFrame:
        return self.agg("cv")

    def idxmax(self) -> RoleFrame:
        return self._statistic(stats.idxmax(self.df, self._order(), self._numeric()))

    def quantile(self, q: float | Sequence[float] = 0.5, exact: bool = True) -> RoleFrame:
        return self._statistic(stats.quantiles(self.df, self._numeric(), q, exact))

    def cov(self) -> RoleFrame:
        return self._statistic(stats.pairwise(self.df, self._numeric(), "cov"))

    def corr(self, method: str = "pearson") -> RoleFrame:
        return self._statistic(stats.pairwise(self.df, self._numeric(), method))

    def mode(self, columns: Sequence[str] | None = None) -> RoleFrame:
        return self._statistic(stats.modes(self.df, list(columns or self._data())))

    def na_counts(self) -> RoleFrame:
        return self._statistic(stats.aggregate(self.df, self._data(), "nulls"))

    def unique(self, most: int = 1_000_000) -> dict[str, list]:
        """The distinct values of each column; they come to the driver, so a column may have ``most`` at most."""
        found = {c: [r[0] for r in self.df.select(_quoted(c)).distinct().limit(most + 1).collect()] for c in self._data()}
        if many := [c for c, v in found.items() if len(v) > most]:
            raise errors.InvalidArgumentError(f"{many} have more than {most} distinct values: use value_counts, or raise most")
        return found

    def nunique(self, approximate: bool = False) -> dict[str, int]:
        count = F.approx_count_distinct if approximate else F.count_distinct
        return self.df.agg(*[count(_quoted(c)).alias(c) for c in self._data()]).first().asDict()

    def value_counts(self, normalize: bool = False, dropna: bool = True, sort: bool = True, ascending: bool = False) -> RoleFrame:
        return self._statistic(stats.value_counts(self.df, self._data(), normalize, dropna, sort, ascending))

    def groupby(self, by: str | Sequence[str] | RoleFrame, functions: str | Callable | Sequence | None = None, columns: Sequence[str] | None = None):
        """Aggregates by key, null keys dropped; without functions a list of (key, frame), keys sorted.

        A frame of one column groups by its values, in the rows that share this frame's key.
        """
        if isinstance(by, RoleFrame):
            if len(by._data()) != 1:
                raise errors.DataTypeError(f"groups come from one column, not from {by._data()}")
            (name,) = by._data()
            beside, names = self._beside(by)
            own = "__group"
            grouped = self.new(beside.select(*self.df.columns, _quoted(names[name]).alias(own)))
            found = grouped.groupby(own, functions, columns)
            if functions is not None:
                return found.rename({own: name})
            return [(k, part.drop(own)) for k, part in found]
        by = [by] if isinstance(by, str) else list(by)
        present = self.df.filter(reduce(operator.and_, (_quoted(b).isNotNull() for b in by)))
        if functions is not None:
            return self._aggregate(present, [c for c in self._numeric(columns) if c not in by], functions, by)
        keys = present.select(*[_quoted(b) for b in by]).distinct().orderBy(*by).collect()
        same = lambda k: reduce(operator.and_, (_quoted(b) == F.lit(v) for b, v in zip(by, k, strict=True)))
        return [(k[0] if len(by) == 1 else tuple(k), self.new(present.filter(same(k)))) for k in keys]

    def sql(self, query: str, **others: RoleFrame) -> RoleFrame:
        """A SQL query over this frame as ``{frame}`` and further frames by their names; roles stay with columns that keep name and type."""
        found = self.df.sparkSession.sql(query, frame=self.df, **{n: f.df for n, f in others.items()})
        kept = {c: r for c, r in self.roles.items() if c in found.columns and found.schema[c].dataType == self.df.schema[c].dataType}
        return RoleFrame(found, kept, self.key if self.key in found.columns else None)

    # order
    def sort(self, by: str | Sequence[str] | None = None, ascending: bool = True) -> RoleFrame:
        by = [by] if isinstance(by, str) else list(by or [self._order()])
        return self.new(self.df.orderBy(*[_quoted(b).asc() if ascending else _quoted(b).desc() for b in by]))

    def sample(self, n: int | None = None, frac: float | None = None, seed: int = 0) -> RoleFrame:
        """Exactly n rows, or the exact fraction, by the order of a hash of the key."""
        from .functions.ranking import hash_labelled, hash_order

        drawn = lambda rank, rows: rank <= (F.lit(n) if n is not None else F.floor(rows * F.lit(frac)))
        return self.new(hash_labelled(self.df, self._order(), hash_order(self._order(), seed), (), drawn, "__drawn").filter("__drawn").drop("__drawn"))

    def demote(self, columns: Iterable[str]) -> RoleFrame:
        """Columns become InfoRole: kept, but out of computations."""
        return self.new(self.df, self.roles | {c: InfoRole(self.roles[c].data_type) for c in columns})


def _binary(name: str, function: Callable[[Column, Column], Column], mask: bool = False, both: bool = False) -> None:
    role = FilterRole() if mask else None
    setattr(RoleFrame, f"__{name}__", lambda self, other: self._each(function, other, role))
    if both:
        setattr(RoleFrame, f"__r{name}__", lambda self, other: self._each(lambda a, b: function(b, a), other, role))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("double")


for _name, _function in {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}.items():
    _binary(_name, _function, mask=True)
for _name, _function in {"and": operator.and_, "or": operator.or_, "xor": operator.ne}.items():
    _binary(_name, _function, mask=True)
for _name, _function in {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": F.try_divide, "pow": F.pow,
    "floordiv": floor_divide, "mod": lambda a, b: a - b * floor_divide(a, b),
}.items():
    _binary(_name, _function, both=True)
RoleFrame.__div__ = RoleFrame.__truediv__
RoleFrame.__hash__ = None
RoleFrame.__invert__ = lambda self: self._each(lambda a, _: ~a, role=FilterRole())
RoleFrame.__neg__ = lambda self: self._each(lambda a, _: -a)
RoleFrame.__pos__ = lambda self: self
RoleFrame.__abs__ = lambda self: self._each(lambda a, _: F.abs(a))
RoleFrame.__round__ = RoleFrame.round
