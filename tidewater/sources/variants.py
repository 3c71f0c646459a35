"""Semi-structured text as variants, and shredded to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a row's text is: whole, no text, not JSON, or with a value that isn't of its column's type.
OK, NONE, MALFORMED, MISFIT = "ok", "none", "malformed", "misfit"


def shredded(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]], state: str = "state") -> DataFrame:
    """``rows`` with a column for each of ``fields`` (name: path and type) and the ``state`` of the text; the text stays.

    A path that isn't there, or a JSON null, is a null of state ``ok``.  Text that isn't JSON has nulls
    and is ``malformed``; a value that can't be had as the type is null and makes the row a ``misfit``.
    A duplicate key makes a text malformed.  Each text is parsed once.
    """
    taken = {c.lower() for c in rows.columns}
    if clash := [c for c in (*fields, state) if c.lower() in taken]:
        raise ValueError(f"columns that exist already: {clash}")
    v = F.col("_variant")
    out = rows.withColumn("_variant", F.try_parse_json(F.col(column)))
    held = {name: F.try_variant_get(v, path, kind) for name, (path, kind) in fields.items()}
    there = [F.try_variant_get(v, path, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, path, "variant")) & held[name].isNull() for name, (path, _) in fields.items()]
    misfit = F.lit(False)
    for x in there:
        misfit = misfit | F.coalesce(x, F.lit(False))
    kind = F.when(F.col(column).isNull(), NONE).when(v.isNull(), MALFORMED).when(misfit, MISFIT).otherwise(OK)
    return out.select(*rows.columns, *[c.alias(n) for n, c in held.items()], kind.alias(state))
