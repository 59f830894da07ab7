"""Comparison of two snapshots of surfaces, keyed by fqn, as one declarative plan.

Both sides are joined once (full outer, on unique keys) and each joined row yields its part of the report in one explode:
rows without a partner in the new snapshot are removed surfaces, matched rows give their changes through higher-order
functions, added required props a change that stays if the base has their component, which only the names of the base
tell. Tokens compare by their text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import owner
from ..schema import PARAM, RANGE, TOKEN

ADDED = "VueRequiredPropAdded"
EMPTY = "cast(array() as array<struct<kind:string,old:{0},new:{0}>>)".format(TOKEN.simpleString())


def differs(a: Column, b: Column) -> Column:
    """Two tokens differ in text, or one is missing."""
    return ~a["text_normalized"].eqNullSafe(b["text_normalized"])


def texts(surfaces: DataFrame) -> DataFrame:
    """The surfaces with their tokens' texts but no places, for reports that show none: places are most of what a surface takes where it is moved."""

    def text(token: Column) -> Column:
        return F.when(token.isNotNull(), F.struct(token["text_normalized"].alias("text_normalized"), F.lit(None).cast(RANGE).alias("source_range")))

    def each(c: Column, names: list[str]) -> list[Column]:
        return [text(c[n]).alias(n) for n in names]

    m, p = F.col("signature.ts_method"), F.col("signature.vue_prop")
    parameters = F.transform(m["parameters"], lambda x: F.struct(*each(x, PARAM.names)))
    method = F.when(m.isNotNull(), F.struct(text(m["async"]).alias("async"), parameters.alias("parameters"), text(m["return_type"]).alias("return_type")))
    prop = F.when(p.isNotNull(), F.struct(*each(p, ["type_annotation", "required"])))
    signature = F.struct(F.col("signature.kind").alias("kind"), method.alias("ts_method"), prop.alias("vue_prop"))
    return surfaces.withColumns({"source_token": text(F.col("source_token")), "signature": F.when(F.col("signature").isNotNull(), signature)})


def _change(kind: str, old: Column | None, new: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast(TOKEN) if old is None else old).alias("old"), new.alias("new"))


def _param_changes(x: Column, y: Column, token: Column) -> Column:
    """Changes of the parameter at one position: x of the base (null: added), y of the new snapshot (null: removed)."""
    none = F.expr(EMPTY)

    def one(kind, field, condition):
        return F.when(condition, F.array(_change(kind, x[field], F.coalesce(y[field], y["name"])))).otherwise(none)

    added = F.when(y["optional"].isNull() & y["default_value"].isNull(), F.array(_change("TsMethodRequiredParamAdded", None, y["name"]))).otherwise(none)
    both = F.concat(
        one("TsMethodParamBecameRequired", "optional", differs(x["optional"], y["optional"]) & y["default_value"].isNull()),
        one("TsMethodParamTypeChanged", "type_annotation", differs(x["type_annotation"], y["type_annotation"])),
        one("TsMethodParamRestChanged", "rest", differs(x["rest"], y["rest"])),
    )
    return F.when(x.isNull(), added).when(y.isNull(), F.array(_change("TsMethodParamRemoved", x["name"], token))).otherwise(both)


def method_changes(base: Column, new: Column, token: Column) -> Column:
    """Changes of a method; token is the new surface's."""
    none = F.expr(EMPTY)
    a = F.when(differs(base["async"], new["async"]), F.array(_change("TsMethodAsyncChanged", base["async"], F.coalesce(new["async"], token)))).otherwise(none)
    other = differs(base["return_type"], new["return_type"])
    r = F.array(_change("TsMethodReturnTypeChanged", base["return_type"], F.coalesce(new["return_type"], token)))
    p = F.flatten(F.zip_with(base["parameters"], new["parameters"], lambda x, y: _param_changes(x, y, token)))
    return F.concat(a, F.when(other, r).otherwise(p))


def prop_changes(base: Column, new: Column, token: Column) -> Column:
    """Changes of a prop; token is the new surface's."""
    t = _change("VuePropTypeChanged", base["type_annotation"], F.coalesce(new["type_annotation"], token))
    r = _change("VuePropBecameRequired", base["required"], new["required"])
    required = differs(base["required"], new["required"]) & new["required"].isNotNull()
    return F.when(differs(base["type_annotation"], new["type_annotation"]), F.array(t)).when(required, F.array(r)).otherwise(F.expr(EMPTY))


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("fqn").alias(f"{name}_fqn"), F.struct("file_path", "source_token", "fqn", "signature").alias(name))


def matched(base: DataFrame, new: DataFrame) -> DataFrame:
    """(base, new) structs of the surfaces in both."""
    return _side(base, "base").join(_side(new, "new"), F.col("base_fqn") == F.col("new_fqn")).select("base", "new")


def removed(base: DataFrame, new: DataFrame) -> DataFrame:
    """Surfaces of base whose fqn is gone."""
    return base.join(new.select("fqn"), "fqn", "left_anti").select("file_path", "source_token", "fqn", "signature")


def added(base: DataFrame, new: DataFrame) -> DataFrame:
    """Surfaces of new whose fqn base lacks."""
    return removed(new, base)


def mismatches(base: DataFrame, new: DataFrame) -> DataFrame:
    """fqns whose signatures are of different kinds."""
    return matched(base, new).where("base.signature.kind <> new.signature.kind").select("base.fqn")


def _found() -> Column:
    """The changes of (base, new), an array; signatures of different kinds fail."""
    b, n = F.col("base.signature"), F.col("new.signature")
    token = F.col("new.source_token")
    found = F.when(b["kind"] == "TsMethod", method_changes(b["ts_method"], n["ts_method"], token)).when(b["kind"] == "VueProp", prop_changes(b["vue_prop"], n["vue_prop"], token))
    bad = F.raise_error(F.concat(F.lit("signature kinds differ for "), F.col("base.fqn"))).cast(f"array<struct<kind:string,old:{TOKEN.simpleString()},new:{TOKEN.simpleString()}>>")
    # the failure sits in the column that is exploded, so no pruning removes it
    return F.when(b["kind"] != n["kind"], bad).otherwise(found)


def changes(pairs: DataFrame) -> DataFrame:
    """(surface of the base, kind, old, new) of (base, new) pairs."""
    return pairs.select(F.col("base").alias("surface"), F.explode(_found()).alias("c")).select("surface", "c.kind", "c.old", "c.new")


def required_props(new_rows: DataFrame, base: DataFrame) -> DataFrame:
    """Changes for added rows that are required props of components that base has."""
    rows = new_rows.where("signature.kind = 'VueProp' AND signature.vue_prop.required IS NOT NULL")
    rows = rows.join(base.select(F.col("fqn").alias("component")), owner(F.col("fqn")) == F.col("component"), "left_semi")
    return rows.select(F.struct("file_path", "source_token", "fqn", "signature").alias("surface"), F.lit(ADDED).alias("kind"), F.lit(None).cast(TOKEN).alias("old"), F.col("signature.vue_prop.required").alias("new"))


def owned(base: DataFrame, new: DataFrame) -> DataFrame:
    """(owned_fqn) of the required props of new whose component base has, once each; told by names alone."""
    asked = new.where("signature.kind = 'VueProp' AND signature.vue_prop.required IS NOT NULL").select("fqn")
    components = base.select(F.col("fqn").alias("component"))
    return asked.join(components, owner(F.col("fqn")) == F.col("component"), "left_semi").select(F.col("fqn").alias("owned_fqn")).distinct()


def diff(base: DataFrame, new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The report in long form: section (removed, breaking_changes), surface, kind, old, new; kind, old and new are null for removed.

    known: ``owned`` of both, where the names of new can be read twice. Then whole surfaces stay where the join by fqn has
    them; without it, the report's rows are dealt once more to look for components.
    """
    none = F.lit(None).cast(TOKEN)
    side = _side(new, "new")
    if known is not None:
        side = side.join(known, F.col("new_fqn") == F.col("owned_fqn"), "left")
    both = _side(base, "base").join(side, F.col("base_fqn") == F.col("new_fqn"), "full_outer")
    gone = F.array(F.struct(F.lit(None).cast("string").alias("kind"), none.alias("old"), none.alias("new")))
    required = F.col("new.signature.vue_prop.required")
    asked = (F.col("new.signature.kind") == "VueProp") & required.isNotNull()
    fresh = F.when(asked if known is None else asked & F.col("owned_fqn").isNotNull(), F.array(_change(ADDED, None, required)))
    rows = F.when(F.col("new_fqn").isNull(), gone).when(F.col("base_fqn").isNull(), fresh).otherwise(_found())
    rows = both.select(F.coalesce("base", "new").alias("surface"), F.explode(rows).alias("c")).select("surface", "c.kind", "c.old", "c.new")
    if known is None:
        # changes of other kinds have their own name as key, so they spread; what it finds doesn't matter
        asked = F.coalesce(F.col("kind") == ADDED, F.lit(False))
        key = F.when(asked, owner(F.col("surface.fqn"))).otherwise(F.col("surface.fqn"))
        names = base.select(F.col("fqn").alias("component")).distinct()
        rows = rows.join(names, key == F.col("component"), "left").where(~asked | F.col("component").isNotNull())
    return rows.select(F.when(F.col("kind").isNull(), "removed").otherwise("breaking_changes").alias("section"), "surface", "kind", "old", "new")


def has_breaks(report: DataFrame) -> bool:
    return not report.isEmpty()
