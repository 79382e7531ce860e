"""Typed coercion of frontmatter values, and validation against a schema, as Column expressions.

Values come as strings (a map of them per note), lists as JSON or comma-separated text. A coercion yields a struct (value, problem,
warning): ``value`` the canonical text or null, ``problem`` why there is none, ``warning`` what was changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.strings import strip

# Field types, words for true and false (English and Portuguese), what a missing field may lead to.
TYPES = ("string", "int", "float", "bool", "date", "datetime", "uuid", "url", "enum", "list")
TRUE_WORDS = ("true", "yes", "1", "on", "sim", "verdadeiro")
FALSE_WORDS = ("false", "no", "0", "off", "nao", "não", "falso")
ON_MISSING = ("ignore", "require", "suggest", "auto")
ISSUE = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())]))


@dataclass(frozen=True)
class FieldRule:
    """What one field must be; limits belong to their types only."""

    type: str
    on_missing: str = "ignore"
    default: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()
    case_insensitive: bool = True
    item_type: str = "string"
    min_items: int | None = None
    max_items: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    aliases: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.type not in TYPES or self.on_missing not in ON_MISSING or self.item_type not in ("string", "int", "float"):
            raise ValueError(f"unknown type or policy: {self.type}, {self.on_missing}, {self.item_type}")
        if self.type == "enum" and not self.values:
            raise ValueError("an enum needs values")
        if self.on_missing == "auto" and self.type not in ("uuid", "datetime"):
            raise ValueError("only uuid and datetime can be made automatically")
        if self.type not in ("int", "float") and (self.minimum is not None or self.maximum is not None):
            raise ValueError("minimum and maximum belong to int and float")
        if self.type != "string" and (self.min_length is not None or self.max_length is not None):
            raise ValueError("min_length and max_length belong to string")


def _result(value: Column, problem: Column | None = None, warning: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    problem = none if problem is None else problem
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"), F.when(problem.isNull(), none if warning is None else warning).alias("warning"))


def _first(*cases: tuple[Column, str]) -> Column:
    """The text of the first case that holds, else null."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, text in cases[1:]:
        out = out.when(condition, text)
    return out


def _limits(number: Column, r: FieldRule) -> list[tuple[Column, str]]:
    out = []
    if r.minimum is not None:
        out.append((number < r.minimum, "below_minimum"))
    if r.maximum is not None:
        out.append((number > r.maximum, "above_maximum"))
    return out


def coerce(raw: Column, r: FieldRule) -> Column:
    """``raw`` (string) as ``r`` wants it; null input gives a null value without a problem."""
    s = strip(raw)
    none = F.lit(None).cast("string")
    if r.type == "string":
        cases = [(F.length(raw) < r.min_length, "too_short")] if r.min_length is not None else []
        cases += [(F.length(raw) > r.max_length, "too_long")] if r.max_length is not None else []
        cases += [(~raw.rlike(f"^(?:{r.pattern})"), "pattern_mismatch")] if r.pattern else []
        return _result(raw, _first(*cases) if cases else none)
    if r.type in ("int", "float"):
        number = s.try_cast("double")
        word = F.when(F.lower(s).isin("true"), F.lit(1.0)).when(F.lower(s).isin("false"), F.lit(0.0))
        number = F.coalesce(number, word)
        bad = number.isNull() & raw.isNotNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        problem = _first((bad, "not_a_number"), *_limits(number, r))
        if r.type == "float":
            return _result(number.cast("string"), problem, _first((word.isNotNull(), "converted")))
        whole = F.coalesce(s.try_cast("long"), number.try_cast("long"))
        return _result(whole.cast("string"), problem, _first((number != F.floor(number), "truncated"), (word.isNotNull(), "converted")))
    if r.type == "bool":
        low = F.lower(s)
        known = F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false")
        return _result(known, _first((known.isNull() & raw.isNotNull(), "not_a_bool")), _first((~low.isin("true", "false"), "converted")))
    if r.type == "date":
        day = F.when(F.left(s, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.left(s, F.lit(10)).try_cast("date").cast("string"))
        return _result(day, _first((day.isNull() & raw.isNotNull(), "not_a_date")), _first((F.length(s) > 10, "truncated")))
    if r.type == "datetime":
        iso = F.replace(s, F.lit(" "), F.lit("T"))
        at = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(iso))
        ok = F.when(at.isNotNull(), F.when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00"))).otherwise(iso))
        return _result(ok, _first((ok.isNull() & raw.isNotNull(), "not_a_datetime")), _first((F.length(iso) == 10, "midnight_added")))
    if r.type == "uuid":
        bare = F.regexp_replace(F.lower(s), r"^urn:uuid:|[{}-]", "")
        dashed = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        ok = F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)
        return _result(ok, _first((ok.isNull() & raw.isNotNull(), "not_a_uuid")), _first((ok != raw, "normalized")))
    if r.type == "url":
        ok = F.when(s.rlike(r"^(?i)https?://[^\s/?#]+"), s)
        return _result(ok, _first((ok.isNull() & raw.isNotNull(), "not_a_url")))
    if r.type == "enum":
        known = F.create_map(*(F.lit(x) for v in r.values for x in ((v.lower() if r.case_insensitive else v), v)))
        found = F.try_element_at(known, F.lower(s) if r.case_insensitive else s)
        return _result(found, _first((found.isNull() & raw.isNotNull(), "not_allowed")), _first((found != raw, "normalized")))
    items = F.coalesce(F.from_json(raw, "array<string>"), F.split(raw, ","))
    items = F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != "")
    cases = []
    if r.item_type != "string":
        kind = {"int": "long", "float": "double"}[r.item_type]
        cases.append((F.exists(items, lambda x: x.try_cast(kind).isNull()), "bad_item"))
    cases += [(F.size(items) < r.min_items, "too_few_items")] if r.min_items is not None else []
    cases += [(F.size(items) > r.max_items, "too_many_items")] if r.max_items is not None else []
    return _result(F.when(raw.isNotNull(), F.to_json(items)), _first(*cases) if cases else none)


def validate(notes: DataFrame, rules: dict[str, FieldRule], column: str = "frontmatter", mode: str = "strict", allow_extra: bool = True, now: Column | None = None) -> DataFrame:
    """``notes`` with a column ``validation``: (valid, errors, warnings, suggestions, generated, data).

    ``column`` maps field names to strings. An alias counts where its canonical field is absent, else it is a conflict. Missing fields
    are errors, suggestions or generated as their rules say; fields without a rule are kept or errors. In mode ``warn_only`` errors become
    warnings. Codes: alias_resolved, alias_conflict, coercion_warning, validation_error, required_missing, field_suggested,
    extra_field_not_allowed. A null map counts as empty.
    """
    given = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    issue = lambda when, field, code, detail=None: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail")))
    errors, warnings, hints, made, data = [], [], [], [], []
    now = F.current_timestamp() if now is None else now
    known = set()
    for name, r in rules.items():
        raw = F.try_element_at(given, F.lit(name))
        has = F.map_contains_key(given, name)
        taken = has
        for other in r.aliases:
            there = F.map_contains_key(given, other)
            warnings.append(issue(there & ~taken, name, "alias_resolved", F.lit(other)))
            warnings.append(issue(there & taken, name, "alias_conflict", F.lit(other)))
            raw = F.when(~taken & there, F.try_element_at(given, F.lit(other))).otherwise(raw)
            taken = taken | there
        known |= {name, *r.aliases}
        out = coerce(raw, r)
        errors.append(issue(taken & out["problem"].isNotNull(), name, "validation_error", out["problem"]))
        warnings.append(issue(taken & out["warning"].isNotNull(), name, "coercion_warning", out["warning"]))
        value = F.when(taken, out["value"])
        if r.on_missing == "require":
            errors.append(issue(~taken, name, "required_missing"))
        elif r.on_missing == "suggest":
            hints.append(issue(~taken, name, "field_suggested", F.lit(r.default)))
            value = F.coalesce(value, F.when(~taken, F.lit(r.default)))
        elif r.on_missing == "auto":
            new = F.uuid() if r.type == "uuid" else F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            made.append(F.when(~taken, F.struct(F.lit(name).alias("key"), new.alias("value"))))
        data.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))))
    extra = F.map_filter(given, lambda k, v: ~k.isin(*sorted(known))) if known else given
    issues = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast(ISSUE)
    entries = lambda parts: F.map_from_entries(F.filter(F.array(*parts), lambda x: x.isNotNull())) if parts else F.create_map().cast("map<string,string>")
    wrong = issues(errors).cast(ISSUE)
    if not allow_extra:
        wrong = F.concat(wrong, F.transform(F.map_keys(extra), lambda k: F.struct(k.alias("field"), F.lit("extra_field_not_allowed").alias("code"), F.lit(None).cast("string").alias("detail"))).cast(ISSUE))
    warned = issues(warnings).cast(ISSUE)
    step = notes.withColumns({"_e": wrong, "_w": warned, "_s": issues(hints).cast(ISSUE), "_g": entries(made), "_d": entries(data)})
    lax = mode == "warn_only"
    kept = F.map_concat("_d", "_g", extra) if allow_extra else F.map_concat("_d", "_g")
    result = F.struct(
        (F.lit(True) if lax else F.size("_e") == 0).alias("valid"), (F.array().cast(ISSUE) if lax else F.col("_e")).alias("errors"), (F.concat("_w", "_e") if lax else F.col("_w")).alias("warnings"),
        F.col("_s").alias("suggestions"), F.col("_g").alias("generated"), kept.alias("data"),
    )
    return step.withColumn("validation", result).drop("_e", "_w", "_s", "_g", "_d")


def issue_counts(validated: DataFrame) -> DataFrame:
    """Issues per kind, field and code over all notes."""
    parts = [validated.select(F.lit(kind).alias("kind"), F.explode(f"validation.{kind}").alias("i")) for kind in ("errors", "warnings", "suggestions")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind", "i.field", "i.code").agg(F.count("*").alias("n"))
