"""The import spec: datasets, join edges and attributes, validated on the driver.

The spec is the only driver-side state. It is immutable; every operator receives it and
returns lazy DataFrames. ``ImportSpec.from_config`` reads the JSON document a normalized
process-mining import config carries (``inputDataBinding.dataSource.datasets`` plus
``miningMetadata.ImportConfiguration.Attributes``), so an existing config runs unchanged
given a map from dataset name to source.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from typing import Any

from ..functions.types import ATTRIBUTE_TYPES, JOIN_KEY_TYPES

# ---------------------------------------------------------------------------
# Dataset kinds and the attribute vocabulary of the import contract.
# ---------------------------------------------------------------------------
KIND_EVENTS = 0
KIND_CASES = 1
KIND_LOOKUP = 2
# dataSource.dataSourceFileType: 0 CSV files, 1 Parquet files, 2 catalog (Delta) tables.
FILE_TYPES = {0: "csv", 1: "parquet", 2: "table"}
IMPORT_TYPES = ("Case", "Activity", "Start", "End", "Resource", "Other")
LEVELS = ("Event", "Case")
FINANCE_TYPES = ("None", "PerEvent", "PerCase", "PerResource")
CASE_HANDLING = ("None", "First", "Last")
# ---------------------------------------------------------------------------


# How uses that ask for one output name are told apart (ours, see plans.names).
NAMINGS = ("strict", "qualify")


class SpecError(ValueError):
    """A spec that cannot describe one event log."""


# What a default value may look like, per attribute type: what a cast from text accepts.
_DEFAULT_FORMS = {
    "String": re.compile(r".*", re.S),
    "Integer": re.compile(r"[+-]?\d+(\.\d*)?"),
    "Float": re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?inf(inity)?|nan", re.I),
    "Date": re.compile(r"\d{4}(-\d{1,2}(-\d{1,2}([ T][\d:.]+)?)?)?"),
    "Boolean": re.compile(r"true|false|t|f|yes|no|y|n|1|0", re.I),
}


@dataclass(frozen=True)
class JoinEdge:
    """Single-key equality link from a dataset column to a column of another dataset."""

    source_column: str
    target_column: str
    target_dataset: str
    key_type: str = "Integer"
    export_name: str | None = None
    # Our extension (DEC-6): prefix for the target's columns when reached through this edge, and
    # (column, output name) pairs that go before it.
    prefix: str = ""
    aliases: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Dataset:
    name: str
    kind: int
    columns: tuple[str, ...]
    joins: tuple[JoinEdge, ...] = ()
    path: str = ""
    # Our extension (DEC-6): (column, output name) pairs of the dataset's own columns.
    aliases: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Attribute:
    name: str
    source_data_type: str = "String"
    import_type: str = "Other"
    level: str = "Event"
    finance: str = "None"
    case_handling: str = "None"
    is_display: bool = False
    is_excluded: bool = False
    default_value: str = ""

    @property
    def handling(self) -> str:
        """Case-level rule with DEC-3 applied: ``None`` means First."""
        return "Last" if self.case_handling == "Last" else "First"


@dataclass(frozen=True)
class Roles:
    """Column names that play each role in an event log (after attribute naming)."""

    case: str
    activity: str
    start: str | None = None
    end: str | None = None
    resource: str | None = None
    # Extra order columns that make the order within a case total (DEC-3).
    tiebreak: tuple[str, ...] = ()

    def order(self) -> tuple[str, ...]:
        """The DEC-3 row order: start, end, then the tiebreak columns."""
        keys = [c for c in (self.start, self.end) if c]
        keys += [c for c in self.tiebreak if c not in keys]
        return tuple(keys)


@dataclass(frozen=True)
class ImportSpec:
    datasets: tuple[Dataset, ...]
    attributes: tuple[Attribute, ...] = ()
    tiebreak: tuple[str, ...] = ()
    check_keys: bool = True
    # Source format named by the config document ("csv", "parquet", "table"), if any.
    source_format: str | None = None
    # Two uses of one column name: "strict" rejects them, "qualify" renames the later one (plans.names).
    naming: str = "strict"

    # -- lookups -------------------------------------------------------------
    @property
    def events(self) -> Dataset:
        return next(d for d in self.datasets if d.kind == KIND_EVENTS)

    @property
    def cases(self) -> Dataset | None:
        return next((d for d in self.datasets if d.kind == KIND_CASES), None)

    @property
    def lookups(self) -> tuple[Dataset, ...]:
        return tuple(d for d in self.datasets if d.kind == KIND_LOOKUP)

    def dataset(self, name: str) -> Dataset:
        for d in self.datasets:
            if d.name == name:
                return d
        raise SpecError(f"no dataset named {name!r}")

    def case_edge(self) -> JoinEdge | None:
        cases = self.cases
        if cases is None:
            return None
        return next((j for j in self.events.joins if j.target_dataset == cases.name), None)

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def roles(self) -> Roles:
        by_role: dict[str, list[str]] = {}
        for a in self.attributes:
            by_role.setdefault(a.import_type, []).append(a.name)
        start = (by_role.get("Start") or [None])[0]
        end = (by_role.get("End") or [None])[0]
        return Roles(
            case=by_role["Case"][0],
            activity=by_role["Activity"][0],
            start=start,
            end=end,
            resource=(by_role.get("Resource") or [None])[0],
            tiebreak=self.tiebreak,
        )

    def with_attributes(self, *attrs: Attribute) -> "ImportSpec":
        return replace(self, attributes=tuple(attrs))

    # -- validation ----------------------------------------------------------
    def validate(self, require_roles: bool = True) -> "ImportSpec":
        if self.naming not in NAMINGS:
            raise SpecError(f"naming must be one of {NAMINGS}")
        names = [d.name for d in self.datasets]
        dupes = sorted({n for n in names if names.count(n) > 1})
        if dupes:
            raise SpecError(f"datasets share a name: {dupes}")
        for d in self.datasets:
            if d.kind not in (KIND_EVENTS, KIND_CASES, KIND_LOOKUP):
                raise SpecError(f"dataset {d.name!r}: unknown Kind {d.kind}")
        kinds = [d.kind for d in self.datasets]
        if kinds.count(KIND_EVENTS) != 1:
            raise SpecError("exactly one events dataset (Kind 0) is required")
        if kinds.count(KIND_CASES) > 1:
            raise SpecError("at most one cases dataset (Kind 1) is allowed")
        known = set(names)
        for d in self.datasets:
            if d.kind == KIND_LOOKUP and d.joins:
                raise SpecError(f"lookup dataset {d.name!r} cannot declare joins of its own")
            for j in d.joins:
                if j.target_dataset not in known:
                    raise SpecError(f"{d.name}.{j.source_column}: target dataset {j.target_dataset!r} is not in the spec")
                if j.target_dataset == d.name:
                    raise SpecError(f"{d.name}: a dataset cannot join itself")
                if j.key_type not in JOIN_KEY_TYPES:
                    raise SpecError(f"{d.name}.{j.source_column}: JoinKeyType must be one of {JOIN_KEY_TYPES}")
                target = self.dataset(j.target_dataset)
                if target.kind == KIND_EVENTS:
                    raise SpecError(f"{d.name}: cannot join to the events dataset")
                if target.kind == KIND_CASES and d.kind != KIND_EVENTS:
                    raise SpecError(f"{d.name}: only the events dataset may link to the cases dataset")
        cases = self.cases
        if cases is not None:
            links = [j for j in self.events.joins if j.target_dataset == cases.name]
            if len(links) != 1:
                raise SpecError(f"cases dataset {cases.name!r} needs exactly one link from the events dataset")
        for a in self.attributes:
            if a.source_data_type not in ATTRIBUTE_TYPES:
                raise SpecError(f"attribute {a.name!r}: SourceDataType must be one of {ATTRIBUTE_TYPES}")
            if a.import_type not in IMPORT_TYPES:
                raise SpecError(f"attribute {a.name!r}: ImportType must be one of {IMPORT_TYPES}")
            if a.level not in LEVELS:
                raise SpecError(f"attribute {a.name!r}: Level must be one of {LEVELS}")
            if a.finance not in FINANCE_TYPES:
                raise SpecError(f"attribute {a.name!r}: FinanceImportType must be one of {FINANCE_TYPES}")
            if a.case_handling not in CASE_HANDLING:
                raise SpecError(f"attribute {a.name!r}: CaseLevelAttributeHandling must be one of {CASE_HANDLING}")
            if a.default_value and not _DEFAULT_FORMS[a.source_data_type].fullmatch(a.default_value.strip()):
                raise SpecError(f"attribute {a.name!r}: default {a.default_value!r} is no {a.source_data_type}")
        attr_names = [a.name for a in self.attributes]
        clash = sorted({n for n in attr_names if attr_names.count(n) > 1})
        if clash:
            raise SpecError(f"attribute names repeat: {clash}")
        if require_roles and self.attributes:
            roles = [a.import_type for a in self.attributes]
            if roles.count("Case") != 1:
                raise SpecError("exactly one attribute must have the Case role")
            if roles.count("Activity") != 1:
                raise SpecError("exactly one attribute must have the Activity role")
            if "Start" not in roles and "End" not in roles:
                raise SpecError("at least one attribute must have the Start or End role")
            for role in ("Start", "End", "Resource"):
                if roles.count(role) > 1:
                    raise SpecError(f"at most one attribute may have the {role} role")
        return self

    # -- JSON config ---------------------------------------------------------
    @classmethod
    def from_config(cls, config: str | dict[str, Any], paths: dict[str, str] | None = None,
                    tiebreak: tuple[str, ...] | None = None, check_keys: bool | None = None,
                    naming: str | None = None) -> "ImportSpec":
        """Read an import config document; ``paths`` overrides dataset paths by name.

        ``tiebreak``, ``check_keys`` and ``naming`` default to the document's ``importOptions`` (ours,
        written by ``to_config``), else to none, on and ``"qualify"``: a document names a dataset once
        however often it is used, so later uses of a column get names of their own.
        """
        from .names import with_derived_attributes

        doc = json.loads(config) if isinstance(config, str) else config
        binding = doc.get("inputDataBinding", doc)
        source = binding.get("dataSource", {})
        raw_sets = source.get("datasets")
        if not raw_sets:
            raise SpecError("config has no dataSource.datasets")
        paths = paths or {}
        datasets = []
        for raw in raw_sets:
            joins = tuple(dict.fromkeys(
                JoinEdge(
                    source_column=j["SourceColumnName"],
                    target_column=j["TargetColumnName"],
                    target_dataset=j["TargetDatasetName"],
                    key_type=j.get("JoinKeyType", "Integer"),
                    export_name=j.get("ExportName") or None,
                    prefix=j.get("Prefix", ""),
                    aliases=tuple((j.get("Aliases") or {}).items()),
                )
                for j in (raw.get("Join") or [])
            ))
            name = raw["Name"]
            datasets.append(Dataset(
                name=name,
                kind=int(raw["Kind"]),
                columns=tuple(c["Name"] for c in (raw.get("Columns") or [])),
                joins=joins,
                path=paths.get(name, raw.get("Path", "")),
                aliases=tuple((c["Name"], c["Alias"]) for c in (raw.get("Columns") or []) if c.get("Alias")),
            ))
        meta = binding.get("miningMetadata", {}).get("ImportConfiguration", {})
        attributes = tuple(
            Attribute(
                name=a["Name"],
                source_data_type=a.get("SourceDataType", "String"),
                import_type=a.get("ImportType", "Other"),
                level=a.get("Level", "Event"),
                finance=a.get("FinanceImportType", "None"),
                case_handling=a.get("CaseLevelAttributeHandling", "None"),
                is_display=bool(a.get("IsDisplayAttribute", False)),
                is_excluded=bool(a.get("IsExcluded", False)),
                default_value=a.get("DefaultValue", "") or "",
            )
            for a in meta.get("Attributes", [])
        )
        missing = [d.name for d in datasets if not d.path]
        if paths and missing:
            raise SpecError(f"no path for datasets {missing}")
        code = source.get("dataSourceFileType")
        if code is not None and int(code) not in FILE_TYPES:
            raise SpecError(f"unknown dataSourceFileType {code!r}")
        fmt = FILE_TYPES[int(code)] if code is not None else None
        options = binding.get("importOptions", {})
        tiebreak = options.get("Tiebreak", ()) if tiebreak is None else tiebreak
        check_keys = bool(options.get("CheckKeys", True)) if check_keys is None else check_keys
        naming = options.get("Naming", "qualify") if naming is None else naming
        spec = cls(tuple(datasets), attributes, tuple(tiebreak), check_keys, fmt, naming).validate()
        return with_derived_attributes(spec) if naming == "qualify" else spec

    def to_config(self) -> dict[str, Any]:
        """The datasets and attributes as a config document (round-trips with ``from_config``)."""
        def edge(j: JoinEdge) -> dict[str, Any]:
            out = {
                "SourceColumnName": j.source_column,
                "TargetColumnName": j.target_column,
                "TargetDatasetName": j.target_dataset,
                "JoinKeyType": j.key_type,
            }
            if j.export_name:
                out["ExportName"] = j.export_name
            if j.prefix:
                out["Prefix"] = j.prefix
            if j.aliases:
                out["Aliases"] = dict(j.aliases)
            return out

        def column(d: Dataset, c: str) -> dict[str, Any]:
            alias = dict(d.aliases).get(c)
            return {"Name": c, "Alias": alias} if alias else {"Name": c}

        return {
            "inputDataBinding": {
                "importOptions": {"Tiebreak": list(self.tiebreak), "CheckKeys": self.check_keys, "Naming": self.naming},
                "dataSource": {
                    "dataSourceSchemaType": 1,
                    **({"dataSourceFileType": {v: k for k, v in FILE_TYPES.items()}[self.source_format]}
                       if self.source_format else {}),
                    "datasets": [
                        {
                            "Kind": d.kind,
                            "Name": d.name,
                            "Path": d.path,
                            "Columns": [column(d, c) for c in d.columns],
                            "Join": [edge(j) for j in d.joins] or None,
                        }
                        for d in self.datasets
                    ],
                },
                "miningMetadata": {
                    "ImportConfiguration": {
                        "Attributes": [
                            {
                                "Name": a.name,
                                "SourceDataType": a.source_data_type,
                                "ImportType": a.import_type,
                                "Level": a.level,
                                "FinanceImportType": a.finance,
                                "CaseLevelAttributeHandling": a.case_handling,
                                "IsDisplayAttribute": a.is_display,
                                "IsExcluded": a.is_excluded,
                                "DefaultValue": a.default_value,
                            }
                            for a in self.attributes
                        ]
                    }
                },
            }
        }


def events(name: str, columns: list[str] | tuple[str, ...], *joins: JoinEdge, path: str = "") -> Dataset:
    return Dataset(name, KIND_EVENTS, tuple(columns), tuple(joins), path)


def cases(name: str, columns: list[str] | tuple[str, ...], *joins: JoinEdge, path: str = "") -> Dataset:
    return Dataset(name, KIND_CASES, tuple(columns), tuple(joins), path)


def lookup(name: str, columns: list[str] | tuple[str, ...], path: str = "") -> Dataset:
    return Dataset(name, KIND_LOOKUP, tuple(columns), (), path)


def edge(source: str, target_dataset: str, target: str, key_type: str = "Integer",
         export_name: str | None = None, prefix: str = "", aliases: dict[str, str] | None = None) -> JoinEdge:
    return JoinEdge(source, target, target_dataset, key_type, export_name, prefix, tuple((aliases or {}).items()))


def attr(name: str, source_data_type: str = "String", import_type: str = "Other", level: str = "Event",
         **kwargs: Any) -> Attribute:
    return Attribute(name, source_data_type, import_type, level, **kwargs)
