"""From file records to the page that shows them and the path to download them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.functions.formats import base_name
from cleanlake.policy import MODULE_CONTEXT_LEVEL

# Pages a record can be viewed on.
RESTORE_PAGE = "/backup/restorefile.php?contextid="
COURSE_PAGE = "/course/view.php?id="
MODULE_PAGES = "/mod/"


def resolve_links(
    files: DataFrame,
    context: DataFrame,
    course_modules: DataFrame,
    module_level: int = MODULE_CONTEXT_LEVEL,
) -> DataFrame:
    """``(id, status, view_url, download_path, download_name)`` for every record.

    ``status`` tells which page it is (``restore``, ``section``, ``view``) or why there is
    none (``nocontext``, ``nomodule``, ``unknowncontext``). Contexts are matched to
    their modules first, so the records, by far the larger side, are shuffled once.
    """
    cm = course_modules.select(F.col("id").alias("cm_id"), F.col("course").alias("cm_course"))
    is_module = F.col("contextlevel") == module_level
    places = (
        context.select(
            F.col("id").alias("contextid"),
            "contextlevel",
            F.when(is_module, F.col("instanceid")).alias("instanceid"),
        )
        .join(cm, F.col("instanceid") == F.col("cm_id"), "left")
        .drop("instanceid")
    )
    joined = files.join(places, "contextid", "left")

    component = F.col("component")
    status = (
        F.when((component == "backup") & (F.col("filearea") == "course"), "restore")
        .when(F.col("contextlevel").isNull(), "nocontext")
        .when(~is_module, "unknowncontext")
        .when(F.col("cm_id").isNull(), "nomodule")
        .when(component == "mod_resource", "section")
        .otherwise("view")
    )
    module = F.replace(component, F.lit("mod_"), F.lit(""))
    view_url = (
        F.when(F.col("status") == "restore", F.concat(F.lit(RESTORE_PAGE), "contextid"))
        .when(
            F.col("status") == "section",
            F.concat(F.lit(COURSE_PAGE), "cm_course", F.lit("#module-"), "cm_id"),
        )
        .when(
            F.col("status") == "view",
            F.concat(F.lit(MODULE_PAGES), module, F.lit("/view.php?id="), "cm_id"),
        )
    )
    parts = F.concat_ws("/", F.lit(""), "contextid", "component", "filearea", "itemid")
    path = F.concat(parts, "filepath", "filename")
    return joined.withColumn("status", status).select(
        "id",
        "status",
        view_url.alias("view_url"),
        path.alias("download_path"),
        base_name("filename").alias("download_name"),
    )


def stored_download(paths: DataFrame, root: str) -> DataFrame:
    """``(path, location, name)`` of stored files offered for download by relative path."""
    return paths.select(
        "path",
        F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("location"),
        base_name("path").alias("name"),
    )
