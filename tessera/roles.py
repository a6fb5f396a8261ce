"""Column roles: what a column means to an experiment, and the type it is held in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Role:
    """Base of all roles. ``data_type`` is a Python type, or None to keep the column's own."""

    data_type: type | None = None

    @property
    def name(self) -> str:
        return type(self).__name__.removesuffix("Role")

    def astype(self, data_type: type | None) -> Role:
        return replace(self, data_type=data_type)

    def as_additional(self, data_type: type | None = None) -> Role:
        """The variant for a derived column."""
        return ADDITIONAL.get(type(self), AdditionalRole)(data_type=data_type or self.data_type)


@dataclass(frozen=True)
class LagRole(Role):
    """A column that repeats ``parent`` some periods earlier."""

    parent: str | None = None
    lag: int | None = None


class InfoRole(Role):
    """Ignored by computations."""


class DefaultRole(Role):
    """Given to columns without a role."""


class FeatureRole(LagRole):
    """A covariate."""


@dataclass(frozen=True)
class TargetRole(Role):
    cofounders: tuple[str, ...] = ()


@dataclass(frozen=True)
class PreTargetRole(LagRole):
    cofounders: tuple[str, ...] = ()


class TreatmentRole(Role):
    """The group of an A/B experiment."""


class GroupingRole(Role):
    """Strata of group matching."""


class StratificationRole(Role):
    """Strata of a split."""


class ConstGroupRole(Role):
    """Groups assigned beforehand."""


class StatisticRole(Role):
    pass


class ResumeRole(Role):
    pass


class FilterRole(Role):
    """A mask."""


class ReportRole(Role):
    pass


class TempRole(Role):
    pass


class TempTreatmentRole(TempRole):
    pass


class TempTargetRole(TempRole):
    pass


class TempGroupingRole(TempRole):
    pass


class AdditionalRole(Role):
    """A derived column."""


class AdditionalTreatmentRole(AdditionalRole):
    pass


class AdditionalGroupingRole(AdditionalRole):
    pass


class AdditionalTargetRole(AdditionalRole):
    pass


class AdditionalFeatureRole(AdditionalRole):
    pass


class AdditionalPreTargetRole(AdditionalRole):
    pass


class AdditionalMatchingRole(AdditionalRole):
    pass


ADDITIONAL: dict[type[Role], type[Role]] = {
    TreatmentRole: AdditionalTreatmentRole,
    GroupingRole: AdditionalGroupingRole,
    TargetRole: AdditionalTargetRole,
    FeatureRole: AdditionalFeatureRole,
    PreTargetRole: AdditionalPreTargetRole,
}

NUMERIC = (int, float)
BY_TYPE = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def python_type(kind: T.DataType) -> type | None:
    """The Python type that stands for a Spark type; None where searches never pick it."""
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, T.IntegralType):
        return int
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return float
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return str
    return object if isinstance(kind, T.ArrayType) else None


def column_roles(roles: Mapping | None) -> dict[str, Role]:
    """{column: role} from {column: role} or {role: column or columns}; roles may be classes."""
    found: dict[str, Role] = {}
    for key, value in (roles or {}).items():
        if isinstance(key, str):
            found[key] = value() if isinstance(value, type) else value
        else:
            role = key() if isinstance(key, type) else key
            for column in [value] if isinstance(value, str) else value:
                found[column] = role
    return found


def matches(role: Role, wanted: Iterable[Role | type[Role]] | Role | type[Role]) -> bool:
    """Whether ``role`` is one of the wanted kinds or a kind of it."""
    wanted = [wanted] if isinstance(wanted, (Role, type)) else wanted
    return any(isinstance(role, w if isinstance(w, type) else type(w)) for w in wanted)
