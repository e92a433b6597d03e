"""JSON payload of delayed module deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why a payload, or an entry of one, names no module.
NO_PAYLOAD, NOT_JSON, NO_MODULES = "no payload", "not JSON", "no modules"
OTHER_TYPE, EMPTY, NO_ID, NO_NUMBER = "modules of another type", "empty list", "no id", "id is no number"


def listed_modules(tasks: DataFrame, payload: str = "customdata", key: str = "id") -> DataFrame:
    """(``task_id``, ``module_id``, ``reason``): a row per entry under ``cms`` of each task's payload.

    A payload is parsed once. Its modules are a list or an object keyed by id, of objects with an ``id``
    that is a number or the text of one. An entry without a module says why in ``reason``, and a
    payload without entries has one such row, so no task is lost.
    """
    parsed = tasks.select(
        F.col(key).alias("task_id"), F.col(payload).isNull().alias("absent"),
        F.try_parse_json(F.col(payload)).alias("parsed"),
    )
    parsed = parsed.withColumn("cms", F.try_variant_get("parsed", "$.cms", "variant"))
    kind = F.schema_of_variant("cms")
    entries = parsed.lateralJoin(
        tasks.sparkSession.tvf.variant_explode_outer(F.col("cms").outer()), how="left"
    )
    text = F.try_variant_get("value", "$.id", "string")
    number = text.try_cast("bigint")
    reason = (
        F.when(F.col("absent"), NO_PAYLOAD)
        .when(F.col("parsed").isNull(), NOT_JSON)
        .when(F.col("cms").isNull() | F.is_variant_null("cms"), NO_MODULES)
        .when(~(kind.startswith("ARRAY") | kind.startswith("OBJECT")), OTHER_TYPE)
        .when(F.col("pos").isNull(), EMPTY)
        .when(text.isNull(), NO_ID)
        .when(number.isNull(), NO_NUMBER)
    )
    return entries.select("task_id", number.alias("module_id"), reason.alias("reason"))


def module_payload(ids: Column, user_id: int) -> Column:
    """Payload of a module deletion run in the name of ``user_id``: an object keyed by id."""
    keyed = F.transform(
        ids.cast("array<string>"), lambda i: F.struct(i, F.struct(i.alias("id")))
    )
    user = F.lit(str(user_id))
    return F.to_json(
        F.struct(
            F.map_from_entries(keyed).alias("cms"),
            user.alias("userid"),
            user.alias("realuserid"),
        )
    )
