"""Which columns are compared, with which partner, and by which rule."""

from __future__ import annotations

from pyspark.sql import types as T

from tallymark.errors import IncompatibleSchemas, UnknownColumn
from tallymark.model import Notice, Options, Pair, Rule

_BY_TYPE = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), Rule.INT),
    ((T.FloatType, T.DoubleType), Rule.FLT),
    ((T.BooleanType,), Rule.BOOL),
    ((T.DateType,), Rule.DATE),
    ((T.TimestampType,), Rule.TS),
    ((T.TimestampNTZType,), Rule.TS_NAIVE),
    ((T.BinaryType,), Rule.BIN),
    ((T.ArrayType,), Rule.ARR),
    ((T.StringType, T.VarcharType, T.CharType), Rule.STR),
)
#: What ``logicalType`` in a field's metadata, or a hint, may say.
LOGICAL = {"uuid": Rule.UUID, "json": Rule.JSON, "enum": Rule.ENUM, "time": Rule.TIME}
_KINDS = (
    {Rule.INT, Rule.DEC, Rule.FLT},
    {Rule.STR, Rule.STR_FOLDED},
    {Rule.TS, Rule.TS_ROUNDED, Rule.TS_NAIVE},
)


def rule_of_type(kind: T.DataType) -> Rule:
    """The rule of a type; whole decimals count as integers, and what isn't known is compared as text."""
    if isinstance(kind, T.DecimalType):
        return Rule.INT if kind.scale == 0 else Rule.DEC
    for types, rule in _BY_TYPE:
        if isinstance(kind, types):
            return rule
    return {"TimeType": Rule.TIME, "VariantType": Rule.JSON}.get(type(kind).__name__, Rule.UNKNOWN)


def rule_of(field: T.StructField, hints: dict[str, str] | None = None) -> Rule:
    said = (hints or {}).get(field.name) or (field.metadata or {}).get("logicalType")
    return LOGICAL.get(said) or rule_of_type(field.dataType)


def _alike(a: Rule, b: Rule) -> bool:
    if a is b or Rule.UNKNOWN in (a, b) or {a, b} == {Rule.UUID, Rule.STR}:
        return True
    return any(a in kinds and b in kinds for kinds in _KINDS)


def _precision(field: T.StructField) -> int:
    return int((field.metadata or {}).get("precision", getattr(field.dataType, "precision", 6) if type(field.dataType).__name__ == "TimeType" else 6))


def pair_fields(s: T.StructField, t: T.StructField, options: Options, hints: dict[str, str] | None = None) -> tuple[Pair | None, list[Notice]]:
    """One rule for both columns, or None where their kinds can't be compared."""
    a, b, notes = rule_of(s, hints), rule_of(t, hints), []
    if not _alike(a, b):
        return None, [Notice(f"{s.name} is left out: {s.dataType.simpleString()} ({a.value}) and {t.dataType.simpleString()} ({b.value}) can't be compared", a, s.name)]
    rule, scale, precision = a, 0, 6
    scales = [f.dataType.scale for f in (s, t) if isinstance(f.dataType, T.DecimalType)]
    if {a, b} == {Rule.UUID, Rule.STR}:
        rule = Rule.UUID
    elif Rule.UNKNOWN in (a, b):
        rule = Rule.UNKNOWN
    elif Rule.FLT in (a, b):
        rule = Rule.FLT
    elif Rule.DEC in (a, b):
        rule = Rule.DEC
        # a whole number against a decimal is held at the decimal's scale, or a fraction would vanish
        scale = min(scales) if a is b else max(scales)
        if len(scales) == 2 and scales[0] != scales[1] or a is not b:
            notes.append(Notice(f"{s.name} is compared at {scale} places: the scales differ", Rule.DEC, s.name))
    elif a in _KINDS[2] or a is Rule.TIME:
        rule, precisions = (a if a is b else Rule.TS), {_precision(s), _precision(t)}
        if len(precisions) > 1 or a is not b:
            rule, precision = (Rule.TS_ROUNDED if len(precisions) > 1 else rule), min(precisions)
        if len(precisions) > 1:
            notes.append(Notice(f"{s.name} is rounded to {precision} digits of a second: the precisions differ", rule, s.name))
    elif rule is Rule.STR and (options.trim or options.case_insensitive):
        rule = Rule.STR_FOLDED
    return Pair(s.name, t.name, rule, s.dataType, t.dataType, scale, precision), notes


def match_columns(
    source: T.StructType,
    target: T.StructType,
    keys: list[str],
    options: Options = Options(),
    columns: list[str] | None = None,
    exclude: list[str] | None = None,
    column_map: dict[str, str] | None = None,
    hints: dict[str, str] | None = None,
) -> tuple[list[Pair], list[Pair], list[str], list[Notice]]:
    """(key pairs, value pairs, columns left out, notices); names are matched without regard to case, after the map.

    A column that only one side has is left out and reported, whichever side it is. Names that neither schema has
    are an error, not ignored.
    """
    by_target = {f.name.lower(): f for f in target.fields}
    by_source = {f.name.lower(): f for f in source.fields}
    renamed = {k.lower(): v.lower() for k, v in (column_map or {}).items()}
    for name in [*keys, *(columns or []), *renamed]:
        if name.lower() not in by_source:
            raise UnknownColumn(f"the source has no column {name}")
    for name in exclude or []:
        if name.lower() not in by_source and name.lower() not in by_target:
            raise UnknownColumn(f"neither side has a column {name}")
    for name in renamed.values():
        if name not in by_target:
            raise UnknownColumn(f"the target has no column {name}")
    chosen = {c.lower() for c in columns} if columns else None
    dropped = {c.lower() for c in exclude or []}
    key_names = [k.lower() for k in keys]
    key_pairs, pairs, left_out, notes = [], [], [], []
    for k in key_names:
        partner = by_target.get(renamed.get(k, k))
        if partner is None:
            raise UnknownColumn(f"the target has no column {renamed.get(k, k)} for the key")
        pair, said = pair_fields(by_source[k], partner, options, hints)
        if pair is None:
            raise IncompatibleSchemas(said[0].message)
        key_pairs.append(pair)
        notes += said
    taken = {p.target.lower() for p in key_pairs}
    for name, f in by_source.items():
        if name in key_names or name in dropped or chosen is not None and name not in chosen:
            continue
        partner = by_target.get(renamed.get(name, name))
        if partner is None:
            left_out.append(f.name)
            notes.append(Notice(f"{f.name} is only in the source", None, f.name))
            continue
        taken.add(partner.name.lower())
        pair, said = pair_fields(f, partner, options, hints)
        notes += said
        if pair is None:
            left_out.append(f.name)
        else:
            pairs.append(pair)
    if chosen is None:
        for name, f in by_target.items():
            if name not in taken and name not in dropped:
                left_out.append(f.name)
                notes.append(Notice(f"{f.name} is only in the target", None, f.name))
    for p in [*key_pairs, *pairs]:
        if p.rule is Rule.UNKNOWN:
            notes.append(Notice(f"{p.source} has a type without a rule and is compared as text", Rule.UNKNOWN, p.source))
    naive = [p.source for p in [*key_pairs, *pairs] if isinstance(p.source_type, T.TimestampNTZType) or isinstance(p.target_type, T.TimestampNTZType)]
    if naive:
        notes.append(Notice(f"timestamps without zone are taken as {options.assume_tz}: {', '.join(naive)}", Rule.TS_NAIVE))
    return key_pairs, pairs, left_out, notes
