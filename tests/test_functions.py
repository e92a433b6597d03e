import io
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cleanlake.functions import mime, predicates
from cleanlake.functions.clock import days_before, years_before
from cleanlake.functions.formats import base_name, format_bytes, gib, mib, minute
from cleanlake.functions.payload import listed_modules, module_payload
from cleanlake.policy import RetentionPolicy
from cleanlake.sources.tables import stored_policy


def epoch(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


def column(spark, values, ddl, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_years_before_keeps_day_and_rolls_leap_day_over():
    assert years_before(epoch(2025, 1, 1, 5), 1) == epoch(2024, 1, 1, 5)
    assert years_before(epoch(2024, 2, 29, 12), 1) == epoch(2023, 3, 1, 12)
    assert years_before(epoch(2024, 2, 29, 12), 4) == epoch(2020, 2, 29, 12)
    assert days_before(1_000_000, 2) == 1_000_000 - 2 * 86_400


@pytest.mark.parametrize("inclusive,kept", [(False, [True, False, False, None]), (True, [True, True, False, None])])
def test_older_than_at_the_boundary(spark, inclusive, kept):
    expr = predicates.older_than("v", 100, inclusive)
    assert column(spark, [99, 100, 101, None], "bigint", expr) == kept


def test_time_range():
    assert predicates.time_range(F.lit(1), since=5) is None


@pytest.mark.parametrize(
    "args,kept",
    [
        (dict(until=10, since=5), [False, True, True, False, False]),
        (dict(until=10, newer=True), [False, False, False, False, True]),
        (dict(until=10), [True, True, True, False, False]),
    ],
)
def test_time_range_bounds(spark, args, kept):
    expr = predicates.time_range(F.col("v"), **args)
    assert column(spark, [4, 5, 9, 10, 11], "bigint", expr) == kept


def test_like_is_case_sensitive_and_keeps_wildcards(spark):
    values = ["report.pdf", "REPORT.pdf", "repXrt.pdf", "50% off", "a\\b"]

    def found(text, sensitive=True):
        return column(spark, values, "string", predicates._like(F.col("v"), text, sensitive))

    assert found("report") == [True, False, False, False, False]
    assert found("report", False) == [True, True, False, False, False]
    assert found("rep_rt") == [True, False, True, False, False]
    assert found("\\%") == [False, False, False, True, False]
    assert found("a\\\\b") == [False, False, False, False, True]
    assert found("r\\eport") == [True, False, False, False, False]


def test_backup_name(spark):
    values = ["a.mbz", "a.MBZ", "a.mbz.zip", "a.mbz\n", "a.mbz\n\n", "ambz"]
    kept = column(spark, values, "string", predicates.is_backup_name("v"))
    assert kept == [True, False, False, True, False, False]


def test_format_bytes(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1024**2, 1024**3 * 5 // 2, 1024**4, 1024**5 * 3, -7, None]
    shown = column(spark, sizes, "bigint", format_bytes("v"))
    assert shown[:10] == [
        "0 bytes", "1 bytes", "1023 bytes", "1 KB", "1.5 KB", "1 MB", "2.5 GB", "1 TB",
        "3072 TB", "0 bytes",
    ]


def test_sizes_names_and_times(spark):
    assert column(spark, [1024 * 1024 * 3 // 2], "bigint", mib("v")) == [1.5]
    assert column(spark, [1024**3], "bigint", gib("v")) == [1.0]
    assert column(spark, ["a/b/c", "c"], "string", base_name("v")) == ["c", "c"]
    assert column(spark, [epoch(2024, 5, 6, 7, 8)], "bigint", minute("v")) == ["2024-05-06 07:08"]


def test_modules_and_reasons_in_every_payload_shape(spark):
    payloads = {
        '{"cms":[{"id":"1"},{"id":2}]}': [(1, None), (2, None)],
        '{"cms":{"7":{"id":"7"},"9":{"id":9}}}': [(7, None), (9, None)],
        # Lists and objects whose entries are not alike.
        '{"cms":[{"id":"x"},{"other":1},5,null,[1],{"id":null},{"id":"3"}]}': [
            (None, "id is no number"), *[(None, "no id")] * 5, (3, None)
        ],
        '{"cms":{"a":{"id":[1]},"b":{"id":"4"}}}': [(4, None), (None, "id is no number")],
        '{"cms":[]}': [(None, "empty list")],
        '{"cms":{}}': [(None, "empty list")],
        '{"cms":"text"}': [(None, "modules of another type")],
        '{"cms":null}': [(None, "no modules")],
        '{"other":1}': [(None, "no modules")],
        "[1]": [(None, "no modules")],
        "garbage": [(None, "not JSON")],
        "": [(None, "not JSON")],
        None: [(None, "no payload")],
    }
    rows = spark.createDataFrame(list(enumerate(payloads)), "id long, customdata string")
    found = {}
    for r in listed_modules(rows).collect():
        found.setdefault(r["task_id"], []).append((r["module_id"], r["reason"]))
    key = lambda e: (e[0] is None, e[0] or 0, e[1] or "")
    for k, (payload, want) in enumerate(payloads.items()):
        assert sorted(found[k], key=key) == sorted(want, key=key), payload


def test_payload_round_trip(spark):
    row = spark.sql("select 1L as id, array(3L, 5L) as ids")
    row = row.select("id", module_payload(F.col("ids"), 2).alias("customdata"))
    assert row.first()[1] == '{"cms":{"3":{"id":"3"},"5":{"id":"5"}},"userid":"2","realuserid":"2"}'
    assert sorted(r["module_id"] for r in listed_modules(row).collect()) == [3, 5]


def test_sniffing():
    cases = {
        b"": mime.EMPTY,
        b"%PDF-1.7": "application/pdf",
        b"\x89PNG\r\n\x1a\n....": "image/png",
        b"PK\x03\x04..": "application/zip",
        b"....ftypisom": "video/mp4",
        b"RIFF....WAVEfmt ": "audio/x-wav",
        b"RIFF....WEBPVP8 ": "image/webp",
        b"text then WAVE": "text/plain",
        b"name" + b"\0" * 253 + b"ustar\x0000": "application/x-tar",
        b"  <!DOCTYPE html><p>": "text/html",
        b"<?xml version='1.0'?>": "text/xml",
        b"plain \xc3\xa9 text\n": "text/plain",
        b"\x00\x01\x02": mime.BINARY,
    }
    assert {head: mime.sniff_bytes(head) for head in cases} == cases


def test_kinds_of_zip_archives():
    def packed(*entries, method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as archive:
            for name, text in entries:
                archive.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_STORED if name == "mimetype" else method)
        return out.getvalue()

    office = "application/vnd.openxmlformats-officedocument."
    kinds = ("[Content_Types].xml", "<x/>" * 50), ("_rels/.rels", "<y/>")
    cases = {
        packed(("mimetype", "application/epub+zip"), ("a.xhtml", "x")): "application/epub+zip",
        packed(("mimetype", "application/vnd.oasis.opendocument.text")): "application/vnd.oasis.opendocument.text",
        packed(*kinds, ("word/document.xml", "z")): office + "wordprocessingml.document",
        packed(*kinds, ("xl/workbook.xml", "z")): office + "spreadsheetml.sheet",
        packed(*kinds, ("ppt/presentation.xml", "z")): office + "presentationml.presentation",
        packed(("a.txt", "word/ is not a folder here")): "application/zip",
        packed(("readme", "x" * 3000), ("xl.txt", "")): "application/zip",
        packed(): mime.BINARY,
        b"PK\x03\x04": "application/zip",
        b"PK\x03\x04" + b"\xff" * 40: "application/zip",
    }
    assert {head: mime.sniff_bytes(head) for head in cases} == cases


def test_settings_as_they_are_stored(spark):
    stored = [("cleanup_backup_timeout_days", " 12 "), ("cleanup_run_autoremove", "1"), ("other", "x"),
              ("cleanup_draft_timeout", ""), ("cleanup_logs_timeout_days", None), ("cleanup_backup_timeout_days", " 12 ")]
    frame = spark.createDataFrame(stored, "name string, value string")
    assert stored_policy(frame) == RetentionPolicy(backup_days=12, auto_remove=True)
    assert stored_policy(frame.limit(0)) == RetentionPolicy()
    for bad in ("a week", "-3", "1.5"):
        with pytest.raises(ValueError):
            RetentionPolicy.from_settings({"cleanup_grades_days": bad})
    with pytest.raises(ValueError):
        stored_policy(frame.union(spark.createDataFrame([("cleanup_run_autoremove", "0")], "name string, value string")))


def test_stored_and_column_form_agree_on_whole_contents(spark):
    far = mime.CHUNK + 70_000
    texts = {
        "": mime.EMPTY,
        "<HTML>": "text/html",
        "x" * 70_000 + "\x01": mime.BINARY,
        "x" * far + "\x00": mime.BINARY,
        " \n" * far + "<title>": "text/html",
        " " * (mime.CHUNK - 3) + "<?xml?>": "text/xml",
        "words": "text/plain",
        "GIF89a": "image/gif",
        "éé%PDF-": "text/plain",
        "éé..WAVE": "text/plain",
        "é.ftyp": "text/plain",
        "éé" + "ftyp": "video/mp4",
        "%!PS\x00": "application/postscript",
    }
    kinds = column(spark, list(texts), "string", mime.sniff_text("v"))
    assert kinds == list(texts.values())
    assert [mime.sniff_bytes(t.encode()) for t in texts] == kinds
    assert column(spark, [None], "string", mime.sniff_text("v")) == [mime.EMPTY]
