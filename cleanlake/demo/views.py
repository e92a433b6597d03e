"""Library tables derived from the sample data set: Spark frames, and the same as SQL.

Every view has a row for each row of a whole sample table (or of each of its groups); none is
filtered. Foreign keys of the sample data all resolve, so some parents have another key here than
there, the negative one, and some contents are stored under another hash: their children are orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.policy import DAY

AS_OF = 1735689600  # 2025-01-01
LOG_CUTOFF = 1705276800  # 2024-01-15
HISTORY_CUTOFF = 915148800  # 1999-01-01
LOG_AS_OF = 1736899200  # 2025-01-15
GRADE_AS_OF = 993945600  # 2001-07-01
DELETE_TASK = "course_delete_modules"


class Views:
    """Views over one folder of sample tables, each built once. None starts a job."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _VIEWS:
            raise AttributeError(name)
        view = _VIEWS[name](self.raw)
        self.__dict__[name] = view
        return view


def _epoch(col: str):
    return F.unix_seconds(F.col(col).cast("timestamp"))


def _text(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def _moved(key, every: int):
    """The key, negative for one of ``every``."""
    return F.when(key % every == 0, -key).otherwise(key)


def _stored_path(h):
    return F.concat(
        F.lit("filedir/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h
    )


def _files(raw):
    d = F.col("doc_id")
    five = d % 5
    component = (
        F.when(five == 0, "assignsubmission_file")
        .when(five == 1, "backup")
        .when(five == 2, "user")
        .when(five == 3, "mod_resource")
        .otherwise("mod_folder")
    )
    area = F.when(five == 1, "course").when((five == 2) & (d % 2 == 0), "draft")
    ending = F.when((five == 1) & (d % 3 != 0), ".mbz").otherwise(".pdf")
    return raw("documents").select(
        d.alias("id"),
        F.md5("text").alias("contenthash"),
        (d % 150).alias("contextid"),
        component.alias("component"),
        area.otherwise("content").alias("filearea"),
        (d % 9).alias("itemid"),
        F.lit("/").alias("filepath"),
        _text("file_", d, ending).alias("filename"),
        (F.col("n_chars") * 8192).alias("filesize"),
        (d % 200).alias("userid"),
        _text("Author ", d % 13).alias("author"),
        (F.lit(AS_OF) - (d * 7 % 1000) * DAY).alias("timecreated"),
        (F.lit(AS_OF) - (d * 11 % 1000) * DAY).alias("timemodified"),
    )


def _user(raw):
    k = F.col("c_custkey")
    return raw("customer").select(
        _moved(k, 7).alias("id"),
        F.col("c_mktsegment").alias("firstname"),
        F.col("c_name").alias("lastname"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("deleted"),
    )


def _course(raw):
    return raw("customer").select(_moved(F.col("c_custkey"), 7).alias("id"))


def _context(raw):
    k = F.col("c_custkey")
    return raw("customer").select(
        _moved(k, 5).alias("id"),
        F.when(k % 4 == 0, 50).otherwise(70).alias("contextlevel"),
        (k * 10).alias("instanceid"),
    )


def _log(raw):
    return raw("events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("contextid"),
        _epoch("ts").alias("timecreated"),
    )


def _analytics_log(raw):
    turn = F.col("turn")
    return raw("conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("id"),
        F.col("conv_id").alias("contextid"),
        (F.lit(AS_OF) - turn * 200 * DAY).alias("timecreated"),
    )


def _modules(raw):
    k = F.col("n_nationkey").cast("bigint")
    return raw("nation").select(k.alias("id"), _text("m", k).alias("name"))


def _course_modules(raw):
    k = F.col("o_orderkey")
    return raw("orders").select(
        _moved(k, 6).alias("id"),
        F.col("o_custkey").alias("course"),
        (k % 30).alias("module"),
        F.when(k % 6 == 0, k % 50 + 100).otherwise(k % 50).alias("instance"),
        (F.col("o_custkey") * 10 + k % 3).alias("section"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("deletioninprogress"),
    )


def _grade_items(raw):
    k = F.col("o_orderkey")
    return raw("orders").select(
        _moved(k, 4).alias("id"),
        F.when(k % 19 != 0, F.col("o_custkey")).alias("courseid"),
        F.when(F.col("o_orderstatus") == "F", "mod").otherwise("manual").alias("itemtype"),
        _text("m", k % 30).alias("itemmodule"),
        (k % 50).alias("iteminstance"),
    )


def _line_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _grade_grades(raw):
    return raw("lineitem").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("itemid"),
        F.col("l_suppkey").alias("userid"),
    )


def _grader(raw):
    return raw("supplier").select(_moved(F.col("s_suppkey"), 5).alias("id"))


def _grade_categories(raw):
    k = F.col("o_orderkey")
    return raw("orders").select(
        k.alias("id"), F.when(k % 97 != 0, F.col("o_custkey")).alias("courseid")
    )


def _category_tree(raw):
    """Categories below others, some in circles, some with a grade item of their own."""
    k = F.col("o_orderkey")
    parent = F.when(k % 100 == 7, k * 3 + 1).otherwise(F.floor(k / 3))
    return raw("orders").select(
        k.alias("id"), parent.cast("bigint").alias("parent"), F.when(k % 17 == 0, k + 1).alias("itemid")
    )


def _grade_outcomes(raw):
    """Outcomes used in courses; some have lost theirs."""
    return raw("lineitem").select(
        _line_id().alias("id"), F.when(F.col("l_linenumber") != 3, F.col("l_suppkey")).alias("courseid")
    )


def _grade_history(raw):
    return raw("lineitem").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("itemid"),
        _epoch("l_shipdate").alias("timemodified"),
    )


def _task(raw):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    payload = (
        F.when(k % 10 == 7, "garbage")
        .when(k % 10 == 8, '{"cms":[]}')
        .when(k % 10 == 9, _text('{"cms":{"a":{"id":"', k, '"}}}'))
        .otherwise(_text('{"cms":[{"id":"', k, '"},{"id":"', k + 1, '"}]}'))
    )
    return raw("orders").select(
        k.alias("id"),
        F.when(c % 4 == 0, "other").otherwise(DELETE_TASK).alias("classname"),
        (c % 3).alias("faildelay"),
        F.when(k % 23 != 0, F.lit(AS_OF) - (k % 20) * DAY).alias("timestarted"),
        payload.alias("customdata"),
    )


def _event(raw):
    return raw("lineitem").select(
        _line_id().alias("id"),
        (F.col("l_partkey") % 50).alias("instance"),
        _text("m", F.col("l_suppkey") % 30).alias("modulename"),
    )


def _completion(raw):
    return raw("lineitem").select(
        _line_id().alias("id"), F.col("l_orderkey").alias("coursemoduleid")
    )


def _viewed(raw):
    return raw("lineitem").select(
        _line_id().alias("id"), F.col("l_partkey").alias("coursemoduleid")
    )


def _criteria(raw):
    k = F.col("o_orderkey")
    return raw("orders").select(
        k.alias("id"),
        k.alias("moduleinstance"),
        F.col("o_custkey").alias("course"),
        (k % 5).cast("int").alias("criteriatype"),
    )


def _disk(raw):
    h = F.col("contenthash")
    # The content of Spanish documents is stored under another hash.
    own = F.when(F.col("lang") == "es", F.md5(F.concat(F.lit("x"), "text"))).otherwise(F.md5("text"))
    stored = [
        raw("documents").select(own.alias("contenthash"), (F.col("n_chars") * 8192).alias("n")),
        raw("pages").select(F.md5("html").alias("contenthash"), F.length("html").alias("n")),
        raw("conversations").select(F.md5("text").alias("contenthash"), F.length("text").alias("n")),
    ]
    every = stored[0].unionByName(stored[1]).unionByName(stored[2])
    return (
        every.groupBy("contenthash")
        .agg(F.max(F.col("n").cast("bigint")).alias("length"))
        .select(_stored_path(h).alias("path"), "contenthash", "length")
    )


def _registry(raw):
    """All pages, and a row for each content of a document: toxic ones by their own hash, which has
    a record again, the others by one without."""
    d = raw("documents").join(raw("labels").select("doc_id", "toxic"), "doc_id", "left")
    own = F.when(F.col("toxic") == 1, F.md5("text")).otherwise(F.md5(F.concat(F.lit("y"), "text")))
    contents = d.groupBy(own.alias("h")).agg(
        F.min("doc_id").alias("doc_id"), F.max(F.col("n_chars") * 8192).alias("size")
    )
    return (
        raw("pages").select(
            F.col("page_id").alias("id"),
            _stored_path(F.md5("html")).alias("path"),
            F.lit("text/plain").alias("mime"),
            F.length("html").cast("bigint").alias("size"),
        )
    ).unionByName(
        contents.select(
            (F.lit(100000000) + F.col("doc_id")).alias("id"),
            _stored_path(F.col("h")).alias("path"),
            F.lit("text/plain").alias("mime"),
            F.col("size").cast("bigint").alias("size"),
        )
    )


def _sections(raw):
    """Sections list most of their modules, in ascending order."""
    k = F.col("o_orderkey")
    listed = F.when(k % 13 != 0, _moved(k, 6))
    return (
        raw("orders")
        .groupBy((F.col("o_custkey") * 10 + k % 3).alias("id"))
        .agg(F.array_sort(F.collect_list(listed)).alias("ids"))
        .select("id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("sequence"))
    )


def _tags(raw):
    line = F.col("l_linenumber")
    return raw("lineitem").select(
        _line_id().alias("id"),
        F.when(line % 2 == 0, "core").otherwise(_text("mod_m", F.col("l_suppkey") % 30)).alias("component"),
        F.col("l_partkey").alias("contextid"),
        F.col("l_orderkey").alias("itemid"),
        F.when(line % 4 == 0, "course_modules").otherwise("post").alias("itemtype"),
    )


_VIEWS = {
    "files": _files,
    "user": _user,
    "course": _course,
    "context": _context,
    "log": _log,
    "analytics_log": _analytics_log,
    "modules": _modules,
    "course_modules": _course_modules,
    "grade_items": _grade_items,
    "grade_grades": _grade_grades,
    "grader": _grader,
    "grade_categories": _grade_categories,
    "category_tree": _category_tree,
    "grade_outcomes": _grade_outcomes,
    "grade_history": _grade_history,
    "task": _task,
    "event": _event,
    "completion": _completion,
    "viewed": _viewed,
    "criteria": _criteria,
    "disk": _disk,
    "registry": _registry,
    "sections": _sections,
    "tags": _tags,
}

_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _moved_sql(key: str, every: int) -> str:
    return f"case when {key} % {every} = 0 then -{key} else {key} end"


def _path_sql(h: str) -> str:
    return f"'filedir/' || substr({h}, 1, 2) || '/' || substr({h}, 3, 2) || '/' || {h}"


VIEW_SQL: dict[str, str] = {
    "files": f"""
        select doc_id as id, md5(text) as contenthash, doc_id % 150 as contextid,
               case doc_id % 5 when 0 then 'assignsubmission_file' when 1 then 'backup'
                    when 2 then 'user' when 3 then 'mod_resource' else 'mod_folder' end as component,
               case when doc_id % 5 = 1 then 'course'
                    when doc_id % 5 = 2 and doc_id % 2 = 0 then 'draft' else 'content' end as filearea,
               doc_id % 9 as itemid, '/' as filepath,
               'file_' || doc_id || case when doc_id % 5 = 1 and doc_id % 3 <> 0
                                         then '.mbz' else '.pdf' end as filename,
               n_chars * 8192 as filesize, doc_id % 200 as userid,
               'Author ' || (doc_id % 13) as author,
               {AS_OF} - (doc_id * 7 % 1000) * {DAY} as timecreated,
               {AS_OF} - (doc_id * 11 % 1000) * {DAY} as timemodified
        from documents""",
    "usr": f"""
        select {_moved_sql("c_custkey", 7)} as id, c_mktsegment as firstname, c_name as lastname,
               case when c_custkey % 5 = 0 then 1 else 0 end as deleted
        from customer""",
    "course": f"select {_moved_sql('c_custkey', 7)} as id from customer",
    "context": f"""
        select {_moved_sql("c_custkey", 5)} as id,
               case when c_custkey % 4 = 0 then 50 else 70 end as contextlevel,
               c_custkey * 10 as instanceid
        from customer""",
    "log": """
        select event_id as id, user_id as contextid, epoch_us(ts) // 1000000 as timecreated
        from events""",
    "analytics_log": f"""
        select conv_id * 1000 + turn as id, conv_id as contextid,
               {AS_OF} - turn * 200 * {DAY} as timecreated
        from conversations""",
    "modules": """
        select cast(n_nationkey as bigint) as id, 'm' || n_nationkey as nm from nation""",
    "cm": f"""
        select {_moved_sql("o_orderkey", 6)} as id, o_custkey as course, o_orderkey % 30 as module,
               case when o_orderkey % 6 = 0 then o_orderkey % 50 + 100 else o_orderkey % 50 end as inst,
               o_custkey * 10 + o_orderkey % 3 as section,
               case when o_orderstatus = 'P' then 1 else 0 end as deletioninprogress
        from orders""",
    "gi": f"""
        select {_moved_sql("o_orderkey", 4)} as id,
               case when o_orderkey % 19 <> 0 then o_custkey end as courseid,
               case when o_orderstatus = 'F' then 'mod' else 'manual' end as itemtype,
               'm' || (o_orderkey % 30) as itemmodule, o_orderkey % 50 as iteminstance
        from orders""",
    "gg": f"""
        select {_LINE_ID} as id, l_orderkey as itemid, l_suppkey as userid from lineitem""",
    "grader": f"select {_moved_sql('s_suppkey', 5)} as id from supplier",
    "gc": """
        select o_orderkey as id,
               case when o_orderkey % 97 <> 0 then o_custkey end as courseid from orders""",
    "grade_outcomes": f"""
        select {_LINE_ID} as id, case when l_linenumber <> 3 then l_suppkey end as courseid from lineitem""",
    "category_tree": """
        select o_orderkey as id,
               case when o_orderkey % 100 = 7 then o_orderkey * 3 + 1 else o_orderkey // 3 end as parent,
               case when o_orderkey % 17 = 0 then o_orderkey + 1 end as itemid from orders""",
    "ggh": f"""
        select {_LINE_ID} as id, l_orderkey as itemid,
               epoch_us(l_shipdate) // 1000000 as timemodified from lineitem""",
    "task": f"""
        select o_orderkey as id,
               case when o_custkey % 4 = 0 then 'other' else '{DELETE_TASK}' end as classname,
               o_custkey % 3 as faildelay,
               case when o_orderkey % 23 <> 0 then {AS_OF} - (o_orderkey % 20) * {DAY} end as timestarted,
               case o_orderkey % 10 when 7 then 'garbage' when 8 then '{{"cms":[]}}'
                 when 9 then '{{"cms":{{"a":{{"id":"' || o_orderkey || '"}}}}}}'
                 else '{{"cms":[{{"id":"' || o_orderkey || '"}},{{"id":"' || (o_orderkey + 1) || '"}}]}}'
               end as customdata
        from orders""",
    "cal_event": f"""
        select {_LINE_ID} as id, l_partkey % 50 as inst, 'm' || (l_suppkey % 30) as modulename
        from lineitem""",
    "completion": f"select {_LINE_ID} as id, l_orderkey as coursemoduleid from lineitem",
    "viewed": f"select {_LINE_ID} as id, l_partkey as coursemoduleid from lineitem",
    "criteria": """
        select o_orderkey as id, o_orderkey as moduleinstance, o_custkey as course,
               cast(o_orderkey % 5 as int) as criteriatype from orders""",
    "disk": f"""
        select {_path_sql("h")} as path, h as contenthash, max(n) as length from (
          select case when lang = 'es' then md5('x' || text) else md5(text) end as h,
                 n_chars * 8192 as n from documents
          union all select md5(html), length(html) from pages
          union all select md5(text), length(text) from conversations) t
        group by h""",
    "registry": f"""
        select page_id as id, {_path_sql("md5(html)")} as path, 'text/plain' as mime,
               length(html) as size
        from pages
        union all
        select 100000000 + min(doc_id) as id, {_path_sql("h")} as path, 'text/plain' as mime,
               max(n_chars * 8192) as size
        from (select d.doc_id, d.n_chars,
                     case when l.toxic = 1 then md5(d.text) else md5('y' || d.text) end as h
              from documents d left join labels l on l.doc_id = d.doc_id) t
        group by h""",
    "sections": f"""
        select o_custkey * 10 + o_orderkey % 3 as id,
               coalesce(string_agg({_moved_sql("o_orderkey", 6)}, ','
                 order by {_moved_sql("o_orderkey", 6)}) filter (o_orderkey % 13 <> 0), '') as "sequence"
        from orders group by 1""",
    "tags": f"""
        select {_LINE_ID} as id,
               case when l_linenumber % 2 = 0 then 'core' else 'mod_m' || (l_suppkey % 30) end as component,
               l_partkey as contextid, l_orderkey as itemid,
               case when l_linenumber % 4 = 0 then 'course_modules' else 'post' end as itemtype
        from lineitem""",
}


def with_views(*names: str, query: str, **more: str) -> str:
    """SQL with the named views, then further named parts, in front of the query."""
    parts = [f"{n} as ({VIEW_SQL[n]})" for n in names]
    parts += [f"{n} as ({sql})" for n, sql in more.items()]
    return "with " + ",\n".join(parts) + "\n" + query
