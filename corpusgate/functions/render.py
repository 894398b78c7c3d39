"""Turning corpus rows into training text (PR1–PR5, MV7–MV8).

A template is compiled once on the driver into a `concat` of literals and
columns, so rendering stays inside whole-stage codegen. When every source
carries its own template (many corpora in one job), `render_by_template_column`
renders from a template *column* with higher-order functions instead.
"""
from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgate import constants as K
from corpusgate.functions.text import col, float_text, nullif_empty, ustrip


class TemplateError(ValueError):
    pass


def render_column(column: str) -> Column:
    """PR1: the column is the text; null or '' renders ''."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _value_text(c: Column, dtype: T.DataType | None) -> Column:
    """How `str()` prints a value inside `str.format`: null is 'None',
    booleans 'True'/'False', floats their shortest digits; strings and integers print as themselves."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise TemplateError("nested columns cannot be rendered into text")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = float_text(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("None"))


def compile_template(template: str, schema: T.StructType | None = None) -> Column:
    """PR2: `template.format(**row)` as one Column. Only plain `{name}` fields
    are accepted (MV8 rejects the rest before rows are read)."""
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    parts: list[Column] = []
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if spec or conversion or not field or field.isdigit():
            raise TemplateError(f"unsupported field {{{field}}} in {template!r}")
        parts.append(_value_text(F.col(f"`{field}`"), types.get(field)))
    return F.concat(*parts) if parts else F.lit("")


def render_by_template_column(template: Column, values: Column) -> Column:
    """PR2 for a per-row template. `values` is a MAP<STRING,STRING> of the
    row's columns printed as text (`row_values_map`; null stays null).
    `{{` / `}}` become braces, a null value prints 'None', and a field
    naming no column renders the whole row as '' (as a failed format does)."""
    tokens = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{[^{}]+\}|[^{}]+|[{}]"), 0)

    def piece(t: Column) -> Column:
        name = t.substr(F.lit(2), F.length(t) - 2)
        return (F.when(t == "{{", F.lit("{")).when(t == "}}", F.lit("}"))
                .when(t.startswith("{") & t.endswith("}") & (F.length(t) > 2),
                      F.when(F.map_contains_key(values, name), F.coalesce(values[name], F.lit("None"))))
                .otherwise(t))
    pieces = F.transform(tokens, piece)
    return F.when(F.exists(pieces, lambda p: p.isNull()), F.lit("")).otherwise(F.array_join(pieces, ""))


def row_values_map(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """MAP<column name, value as text> of a row; booleans print True/False,
    nulls stay null. Nested columns are left out (they cannot be text)."""
    entries = []
    for f in schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue
        c = F.col(f"`{f.name}`")
        text = F.when(c, F.lit("True")).when(~c, F.lit("False")) if isinstance(f.dataType, T.BooleanType) \
            else float_text(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
        entries += [F.lit(f.name), text]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def template_columns(template) -> Column:
    """PR3: the `{column}` names a template reads, in order of first use,
    each cut at the first '.' and '[' and stripped; empties dropped."""
    names = F.regexp_extract_all(F.coalesce(col(template), F.lit("")), F.lit(K.TEMPLATE_FIELD_PATTERN), 1)
    cut = F.transform(names, lambda n: ustrip(F.split(F.split(n, r"\.", 2)[0], r"\[", 2)[0]))
    return F.array_distinct(F.filter(cut, lambda n: n != ""))


def columns_used(text_column, text_template) -> Column:
    """PR4: `[text_column]` when set, else the template's columns."""
    tc = nullif_empty(text_column)
    return F.when(tc.isNotNull(), F.array(tc)).otherwise(template_columns(text_template))


def template_is_valid(template, cols: Column | None = None) -> Column:
    """MV8: `str.format(**{c: '' for c in template_columns})` would succeed.

    Plain `{name}` fields, `{{` and `}}` only, every name one of the template
    columns (`cols`, computed here when not given) and not a positional index."""
    t = col(template)
    shape_ok = t.rlike(K.TEMPLATE_VALID_PATTERN)
    fields = F.filter(F.regexp_extract_all(t, F.lit(K.TEMPLATE_TOKEN_PATTERN), 1), lambda n: n != "")
    cols = template_columns(t) if cols is None else cols
    names_ok = F.forall(fields, lambda n: F.array_contains(cols, n) & ~n.rlike(r"^[0-9]+$"))
    return shape_ok & names_ok


def source_subject(path, name, split) -> Column:
    """PR5: `path [config] / split`; an empty config is left out."""
    cfg = nullif_empty(name)
    return F.concat(col(path),
                    F.when(cfg.isNotNull(), F.concat(F.lit(" ["), cfg, F.lit("]"))).otherwise(F.lit("")),
                    F.lit(" / "), F.coalesce(col(split), F.lit("None")))


def benchmark_subject(name) -> Column:
    """PR6."""
    return F.concat(F.lit("benchmark "), col(name))
