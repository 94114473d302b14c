"""Numbers, JSON values, identifiers and time stamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def rounded(x: Column, places: int) -> Column:
    """Half away from zero on the binary value, the same on every engine."""
    unit = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / F.lit(unit)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def canonical_json(text: Column) -> Column:
    """Sorted keys and plain numbers; null for blank, invalid and empty objects, which all mean no properties."""
    return F.nullif(F.to_json(F.try_parse_json(text)), F.lit("{}"))


def may_have(props: Column, key: str) -> Column:
    """Whether JSON text can hold a key: by its letters, or by escapes that may spell them."""
    return F.contains(props, F.lit(key)) | F.contains(props, F.lit("\\u"))


def prop(parsed: Column, key: str) -> Column:
    """A scalar property of parsed JSON (a variant) as text; lists, objects and absent keys are null."""
    value = F.try_variant_get(parsed, f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    return F.when(~(kind.startswith("ARRAY") | kind.startswith("OBJECT")), F.try_variant_get(value, "$", "string"))


def is_rfc3339(text: Column) -> Column:
    return text.rlike(RFC3339) & F.try_to_timestamp(text).isNotNull()


def is_safe_id(text: Column) -> Column:
    return F.coalesce(text.rlike(SAFE_ID) & ~F.contains(text, F.lit("..")), F.lit(False))


def is_safe_path(path: Column) -> Column:
    """A relative path that stays inside its root."""
    plain = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.coalesce((plain != "") & ~plain.startswith("/") & ~plain.rlike(r"^[A-Za-z]:") & ~plain.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def violations(*checks: tuple[Column, str, str]) -> Column:
    """Array of (field, message) of the checks that fail."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for ok, field, message in checks]))
