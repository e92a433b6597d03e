"""The same queries as SQL, to check results against another engine."""

from __future__ import annotations

from cleanlake.demo import views
from cleanlake.demo.queries import POLICY
from cleanlake.demo.views import with_views
from cleanlake.functions.clock import years_before
from cleanlake.policy import DAY

A = views.AS_OF
Y1, Y2 = years_before(A, 1), years_before(A, 2)
LC, HC = views.LOG_CUTOFF, views.HISTORY_CUTOFF
BACKUP_CUT = A - POLICY.backup_days * DAY
DRAFT_CUT = A - POLICY.draft_days * DAY
COMPONENT_CUT = A - POLICY.component_file_days * DAY
TASK_CUT = A - POLICY.module_task_days * DAY
MIB = 1024 * 1024

# --- logs and grades ------------------------------------------------------------------


def _orphan_or_aged(child: str, parent: str, fk: str, ts: str, cutoff: int) -> str:
    return f"""
    select t.*, case when {ts} < {cutoff} then 'aged' else 'orphan' end as reason
    from {child} t
    where {ts} < {cutoff} or not exists (select 1 from {parent} p where p.id = t.{fk})"""


def _missing(child: str, parent: str, fk: str, extra: str = "true") -> str:
    return f"""
    select t.* from {child} t
    where {extra} and not exists (select 1 from {parent} p where p.id = t.{fk})"""


DELETED_MODULE = """
    select t.* from gi t where t.itemtype = 'mod' and not exists (
      select 1 from cm c where c.course = t.courseid and c.inst = t.iteminstance)"""

LOG_SURVIVORS = with_views(
    "log",
    "context",
    query=f"""select t.* from log t where timecreated >= {LC}
    and exists (select 1 from context p where p.id = t.contextid)""",
)

# --- modules --------------------------------------------------------------------------

STALLED = f"""
    select * from task where classname = '{views.DELETE_TASK}' and faildelay > 0
      and timestarted < {TASK_CUT}"""

TASK_MODULES = """
    select l.task_id, l.module_id,
           case when l.module_id is null then null when c.id is null then 'absent'
                when m.nm is null then 'failed' else 'deleted' end as outcome
    from (select s.id as task_id, try_cast(u.x as bigint) as module_id
          from stalled s left join (
            select id, unnest(list_concat(
                     coalesce(json_extract_string(doc, '$.cms[*].id'), []),
                     coalesce(json_extract_string(doc, '$.cms.*.id'), []))) as x
            from (select id, case when json_valid(customdata) then customdata end as doc
                  from stalled)) u on u.id = s.id) l
    left join cm c on c.id = l.module_id
    left join modules m on m.id = c.module"""

TASK_OUTCOMES = """
    select task_id, count(module_id) as n_modules,
           count(*) filter (where outcome = 'failed') as n_failed,
           count(*) filter (where outcome = 'failed') = 0 as removed
    from task_modules group by task_id"""

ORPHAN_CM = "select c.* from cm c where not exists (select 1 from course p where p.id = c.course)"

# Doomed modules are those in `lost` with a known type.
DOOMED_CM = """
    select l.*, m.nm as module_name, x.id as contextid
    from lost l join modules m on m.id = l.module
    left join context x on x.contextlevel = 70 and x.instanceid = l.id"""

CASCADES = {
    "context": ("context", "t.contextlevel = 70 and d.id = t.instanceid"),
    "files": ("files", "d.contextid = t.contextid"),
    "event": ("cal_event", "d.inst = t.inst and d.module_name = t.modulename"),
    "grade_items": (
        "gi",
        "t.itemtype = 'mod' and d.module_name = t.itemmodule and d.inst = t.iteminstance "
        "and d.course = t.courseid",
    ),
    "course_modules_completion": ("completion", "d.id = t.coursemoduleid"),
    "course_modules_viewed": ("viewed", "d.id = t.coursemoduleid"),
    "course_completion_criteria": (
        "criteria",
        "t.criteriatype = 4 and d.id = t.moduleinstance and d.course = t.course",
    ),
}
DOOMED_VIEWS = ("cm", "course", "modules", "context")


# Modules left when those of deleted courses are gone; types that are unknown stay.
LEFT_CM = f"""
    select c.* from cm c where not exists (
      select 1 from ({ORPHAN_CM}) o join modules m on m.id = o.module where o.id = c.id)"""

LISTED_TASK_MODULES = TASK_MODULES.replace("join cm c", "join cm1 c").replace(
    "else 'deleted' end",
    """when not exists (select 1 from sections s where s.id = c.section and list_contains(
           string_split(s."sequence", ','), cast(c.id as varchar))) then 'unlisted'
         else 'deleted' end""",
)


def _by_module(condition: str) -> str:
    query = f"select t.* from tags t where exists (select 1 from doomed d where {condition})"
    return with_views(*DOOMED_VIEWS, "tags", lost=ORPHAN_CM, doomed=DOOMED_CM, query=query)


def _cascade_rows(table: str, select: str = "t.*") -> str:
    view, condition = CASCADES[table]
    return f"select {select} from {view} t where exists (select 1 from doomed d where {condition})"


def _cascade(table: str, select: str = "t.*") -> str:
    views_ = dict.fromkeys([*DOOMED_VIEWS, CASCADES[table][0]])
    return with_views(
        *views_, lost=ORPHAN_CM, doomed=DOOMED_CM, query=_cascade_rows(table, select)
    )


def _requeue(block: str) -> str:
    return f"""
    select course, count(*) as n_modules, '{views.DELETE_TASK}' as classname,
           '{{"cms":{{' || string_agg('"' || id || '":{{"id":"' || id || '"}}', ',' order by id)
           || '}},"userid":"2","realuserid":"2"}}' as customdata
    from (select course, id, {block} as block from cm where deletioninprogress = 1)
    group by course, block"""


# --- storage --------------------------------------------------------------------------

GHOSTS = """
    select * from disk d where not exists (
      select 1 from files f where f.contenthash = d.contenthash)"""

STATE = f"""
    select f.contenthash, count(*) as n,
           count(*) filter (where bk) as n_backups,
           min(id) filter (where bk) as first_backup,
           max(id) filter (where filearea = 'draft' and timecreated <= {DRAFT_CUT}) as draft,
           exists (select 1 from disk d where d.contenthash = f.contenthash) as present
    from marked f group by f.contenthash"""

MARKED = f"""
    select *, regexp_matches(filename, '\\.mbz\\n?\\z') and timecreated <= {BACKUP_CUT} as bk
    from files"""

ACTIONS = """
    select f.id, f.contenthash,
           case when not s.present then 'missing'
                when f.id > s.first_backup then 'content_gone'
                when f.id = s.first_backup then 'backup'
                when s.n = 1 and f.id = s.draft then 'draft' else 'keep' end as action
    from files f join state s using (contenthash)"""

SAFE_ACTIONS = """
    select f.id, f.contenthash,
           case when not s.present then 'missing' when f.bk then 'backup'
                when s.n = 1 and f.id = s.draft then 'draft' else 'keep' end as action
    from marked f join state s using (contenthash)"""

UNLINKS = """
    select contenthash, case when {backup} then 'backup' else 'draft' end as reason
    from state where present and ({backup} or (first_backup is null and n = 1 and draft is not null))"""


def _checkout(query: str) -> str:
    return with_views("files", "disk", marked=MARKED, state=STATE, query=query)


def _control(col: str) -> str:
    return f"regexp_matches({col}, '[\\x00-\\x06\\x0B\\x0E-\\x1A\\x1C-\\x1F]')"


def _mime(col: str) -> str:
    lead = f"lower(regexp_replace({col}, '^\\s+', ''))"
    tags = " or ".join(
        f"starts_with({lead}, '{t}')"
        for t in ("<!doctype html", "<html", "<head", "<title", "<body")
    )
    return f"""case when {col} is null or {col} = '' then 'application/x-empty'
        when starts_with({col}, '%PDF-') then 'application/pdf'
        when starts_with({col}, '{{\\rtf') then 'text/rtf'
        when starts_with({col}, '%!PS') then 'application/postscript'
        when {_control(col)} then 'application/octet-stream'
        when starts_with({lead}, '<?xml') then 'text/xml'
        when {tags} then 'text/html' else 'text/plain' end"""


# --- search and statistics ------------------------------------------------------------


def _found(where: str, columns: str, tail: str = "") -> str:
    return f"""
    select {columns} from (
      select f.*, u.deleted as user_deleted, u.firstname, u.lastname,
             row_number() over (partition by f.contenthash order by f.id) as nth
      from files f left join usr u on u.id = f.userid where {where}) t
    where nth = 1 {tail}"""


LISTING = f"""id, filename, component || ', ' || filearea as place,
    round(filesize / {1024.0**2}, 1) as size_mib,
    concat_ws(' ', firstname, lastname) as user_name,
    coalesce(user_deleted, 0) = 1 as user_deleted,
    strftime(to_timestamp(timecreated) at time zone 'UTC', '%Y-%m-%d %H:%M') as created,
    component like 'mod\\_%' escape '\\'
      or (component = 'backup' and filearea = 'course') as previewable"""


def _count(where: str) -> str:
    return f"""
    select count(*) as n_records, count(distinct f.contenthash) as n_contents,
           least(count(*), 1000) as shown_total
    from files f left join usr u on u.id = f.userid where {where}"""


USER_LIKE = """(u.firstname || ' ' || u.lastname like '%MACH%'
      or u.lastname || ' ' || u.firstname like '%MACH%' or f.author like '%MACH%')"""

FILE_COLUMNS = (
    "id, contenthash, contextid, component, filearea, itemid, filepath, filename, filesize, "
    "userid, author, timecreated, timemodified, user_deleted, firstname, lastname"
)


def _file_stats(where: str = "true") -> str:
    ts = "case when component = 'backup' then timemodified else timecreated end"
    return f"""
    select component, p.period, count(*) filter (where p.hit) as n_files,
           cast(coalesce(sum(filesize) filter (where p.hit), 0) as bigint) as n_bytes
    from (select component, filesize, unnest([
            {{'period': 'all', 'hit': true}},
            {{'period': 'last_year', 'hit': {ts} > {Y1}}},
            {{'period': 'year_before', 'hit': {ts} >= {Y2} and {ts} < {Y1}}}]) as p
          from files where {where})
    group by component, p.period"""


def _usage(files: str, *history: tuple) -> str:
    parts = [
        f"select '{table}', null, null, null, 'skipped'" if view is None else _history(table, view, ts, A)
        for table, view, ts in history
    ]
    stats = _file_stats("component in ('assignsubmission_file', 'backup')").replace(
        "from files where", f"from {files} where"
    )
    return f"""
    select *, {_shown("n_bytes")} as shown,
           strftime(to_timestamp(case period when 'last_year' then {Y1} when 'year_before'
             then {Y2} end) at time zone 'UTC', '%Y-%m-%d') as since,
           strftime(to_timestamp(case when period = 'year_before' then {Y1} when period is not
             null then {A} end) at time zone 'UTC', '%Y-%m-%d') as until from (
      select 'files' as section, component as item, period, n_files as n,
             cast(n_bytes as double) as n_bytes, 'ok' as status
      from ({stats})
      union all
      select 'history', "table", period, n_rows, n_bytes, status from ({" union all ".join(parts)}))"""


def _fixpoint() -> str:
    """Edges between rows by rule, then the rows reached from the seeds, each at its least depth."""
    rules = [
        ("course_modules", "cm", "course", "course", "c.course = p.id"),
        ("grade_items", "gi", "course", "course", "c.courseid = p.id"),
        ("grade_items", "gi", "course_modules", "cm",
         "c.courseid = p.course and c.iteminstance = p.inst and c.itemtype = 'mod'"),
        ("context", "context", "course_modules", "cm", "c.instanceid = p.id and c.contextlevel = 70"),
        ("files", "files", "context", "context", "c.contextid = p.id"),
        ("grade_grades", "gg", "grade_items", "gi", "c.itemid = p.id"),
        ("completion", "completion", "course_modules", "cm", "c.coursemoduleid = p.id"),
        ("categories", "category_tree", "categories", "category_tree", "c.parent = p.id"),
        ("grade_items", "gi", "categories", "category_tree",
         "c.iteminstance = p.id and c.itemtype = 'manual'"),
        ("categories", "category_tree", "grade_items", "gi", "c.itemid = p.id"),
    ]
    edges = " union all ".join(
        f"""select '{parent}' as pt, p.id::varchar as pid, '{child}' as ct, c.id::varchar as cid,
            {k} as rank, '{child}_of_{parent}' as rule from {c} c join {p} p on {on}"""
        for k, (child, c, parent, p, on) in enumerate(rules)
    )
    return f"""
    , edges as materialized ({edges}),
    reached as (
      with recursive r(t, id, depth) using key (t, id) as (
        select 'course', u.id::varchar, 0 from usr u join course c on c.id = u.id where firstname = 'BUILDING'
        union
        select e.ct, e.cid, min(r.depth) + 1 from r join edges e on e.pt = r.t and e.pid = r.id
        where not exists (select 1 from recurring.r k where k.t = e.ct and k.id = e.cid)
        group by e.ct, e.cid
      ) select * from r)
    select r.t as "table", r.id, r.depth::int as depth, coalesce((
      select arg_min(e.rule, e.rank) from edges e join reached q on q.t = e.pt and q.id = e.pid
      where e.ct = r.t and e.cid = r.id and q.depth = r.depth - 1 and r.depth > 0), 'seed') as rule
    from reached r"""


def _history(table: str, view: str, ts: str, as_of: int, size: str = "n * 1024.0") -> str:
    one, two = years_before(as_of, 1), years_before(as_of, 2)
    return f"""
    select '{table}' as "table", p.period, p.n as n_rows,
           case when p.period = 'all' then cast({size} as double)
                when n > 0 then cast({size} as double) * (cast(p.n as double) / n)
                else 0.0 end as n_bytes, 'ok' as status
    from (select n, unnest([{{'period': 'all', 'n': n}}, {{'period': 'last_year', 'n': n1}},
                            {{'period': 'year_before', 'n': n2}}]) as p
          from (select count(*) as n, count(*) filter (where {ts} >= {one}) as n1,
                       count(*) filter (where {ts} >= {two} and {ts} < {one}) as n2
                from {view}))"""


def _shown(v: str) -> str:
    def unit(power: int, name: str) -> str:
        value = f"round({v} / {float(1024**power)!r}, 2)"
        return f"regexp_replace(cast({value} as varchar), '\\.0$', '') || ' {name}'"

    return f"""case when {v} < 1024.0 then {unit(0, "bytes")}
        when {v} < {1024.0**2} then {unit(1, "KB")} when {v} < {1024.0**3} then {unit(2, "MB")}
        when {v} < {1024.0**4} then {unit(3, "GB")} else {unit(4, "TB")} end"""


# --- the whole clean-up ---------------------------------------------------------------


def _anti(rows: str, doomed: str) -> str:
    return f"select t.* from {rows} t where not exists (select 1 from {doomed} d where d.id = t.id)"


def _first(*rules: tuple[str, str]) -> str:
    parts = " union all ".join(
        f"select id, {i} as rank, '{name}' as rule from ({sql})"
        for i, (name, sql) in enumerate(rules)
    )
    return f"select id, arg_min(rule, rank) as rule from ({parts}) group by id"


def _cleanup_parts(recheck: bool = True) -> dict[str, str]:
    ghost = _anti_hash("registry", "files2") if recheck else "select * from registry"
    return {
        "stalled": STALLED,
        "cm1": LEFT_CM,
        "task_modules": TASK_MODULES.replace("join cm c", "join cm1 c"),
        "gone_tasks": f"select task_id as id, 'resolved_task' as rule from ({TASK_OUTCOMES}) where removed",
        "gone_cm": _first(
            (
                "deleted_course",
                f"select c.id from ({ORPHAN_CM}) c join modules m on m.id = c.module",
            ),
            (
                "stalled_task",
                "select module_id as id from task_modules where outcome = 'deleted'",
            ),
        ),
        "lost": "select c.* from cm c semi join gone_cm using (id)",
        "doomed": DOOMED_CM,
        "gone_context": _cascade_rows("context"),
        "gone_files1": _cascade_rows("files"),
        "gone_events": _cascade_rows("event"),
        "gone_gi1": _cascade_rows("grade_items"),
        "gone_completion": _cascade_rows("course_modules_completion"),
        "gone_viewed": _cascade_rows("course_modules_viewed"),
        "gone_criteria": _cascade_rows("course_completion_criteria"),
        "cm2": _anti("cm", "gone_cm"),
        "gi1": _anti("gi", "gone_gi1"),
        "gone_gi2": _first(
            ("deleted_course", _missing("gi1", "course", "courseid", "t.courseid is not null")),
            ("deleted_module", DELETED_MODULE.replace("gi t", "gi1 t").replace("cm c", "cm2 c")),
        ),
        "gi2": _anti("gi1", "gone_gi2"),
        "gone_gg": _first(
            ("deleted_item", _missing("gg", "gi2", "itemid")),
            ("deleted_user", _missing("gg", "grader", "userid")),
        ),
        "gone_gc": _first(("deleted_course", _missing("gc", "course", "courseid"))),
        "gone_ggh": "select id, 'deleted_item_or_aged' as rule from ("
        + _orphan_or_aged("ggh", "gi2", "itemid", "timemodified", HC)
        + ")",
        "context2": _anti("context", "gone_context"),
        "gone_log": _orphan_or_aged("log", "context2", "contextid", "timecreated", LC),
        "files1": _anti("files", "gone_files1"),
        "gone_files2": f"""
            select id, component as rule, filesize from files1
            where component in ('assignsubmission_file', 'backup') and timecreated < {COMPONENT_CUT}""",
        "files2": _anti("files1", "gone_files2"),
        "gone_registry1": ghost,
        "registry2": _anti("registry", "gone_registry1"),
        "disk2": """select * from disk d where not exists (
            select 1 from gone_registry1 g where g.path = d.path)""",
        "marked": MARKED.replace("from files", "from files2"),
        "state": STATE.replace("from disk", "from disk2"),
        "actions": f"""select a.*, f.filesize from ({ACTIONS.replace("from files f", "from files2 f")}) a
            join files f on f.id = a.id where a.action <> 'keep'""",
    }


def _anti_hash(registry: str, files: str) -> str:
    return f"""select r.* from {registry} r where not exists (
        select 1 from {files} f where f.contenthash = split_part(r.path, '/', 4))"""


_CLEANUP_VIEWS = (
    "files", "course", "context", "log", "modules", "cm", "gi", "gg", "grader", "gc", "ggh",
    "task", "cal_event", "completion", "viewed", "criteria", "disk", "registry",
)

# (step, table, rules in order, rows with id, rule, bytes)
_DOOMED = (
    ("course_modules", "task_adhoc", ("resolved_task",), "select id, rule, 0 as bytes from gone_tasks"),
    ("course_modules", "course_modules", ("deleted_course", "stalled_task"), "select id, rule, 0 as bytes from gone_cm"),
    ("course_modules", "context", ("module_context",), "select id, 'module_context' as rule, 0 as bytes from gone_context"),
    ("course_modules", "files", ("module_files",), "select id, 'module_files' as rule, filesize as bytes from gone_files1"),
    ("course_modules", "event", ("module_event",), "select id, 'module_event' as rule, 0 as bytes from gone_events"),
    ("course_modules", "grade_items", ("module_grade_items",), "select id, 'module_grade_items' as rule, 0 as bytes from gone_gi1"),
    ("course_modules", "course_modules_completion", ("module_course_modules_completion",), "select id, 'module_course_modules_completion' as rule, 0 as bytes from gone_completion"),
    ("course_modules", "course_modules_viewed", ("module_course_modules_viewed",), "select id, 'module_course_modules_viewed' as rule, 0 as bytes from gone_viewed"),
    ("course_modules", "course_completion_criteria", ("module_course_completion_criteria",), "select id, 'module_course_completion_criteria' as rule, 0 as bytes from gone_criteria"),
    ("grades", "grade_items", ("deleted_course", "deleted_module"), "select id, rule, 0 as bytes from gone_gi2"),
    ("grades", "grade_grades", ("deleted_item", "deleted_user"), "select id, rule, 0 as bytes from gone_gg"),
    ("grades", "grade_categories", ("deleted_course",), "select id, rule, 0 as bytes from gone_gc"),
    ("grades", "grade_outcomes_courses", ("deleted_course",), "select id, rule, 0 as bytes from gone_gc"),
    ("grades", "grade_grades_history", ("deleted_item_or_aged",), "select id, rule, 0 as bytes from gone_ggh"),
    ("logs", "logstore_standard_log", ("no_context_or_aged",), "select id, 'no_context_or_aged' as rule, 0 as bytes from gone_log"),
    ("logs", "logstore_lanalytics_log", ("no_context_or_aged",), None),
    ("component_files", "files", ("assignsubmission_file", "backup"), "select id, rule, filesize as bytes from gone_files2"),
    ("ghost_files", "ghost_registry", ("ghost", "linked_again"), "select id, 'ghost' as rule, size as bytes from gone_registry1 union all select id, 'linked_again', size from registry2"),
    ("files_checkout", "files", ("missing", "content_gone", "backup", "draft"), "select id, action as rule, filesize as bytes from actions"),
)


def _report_order() -> list[tuple[str, str, str, str]]:
    entries = [
        (step, table, rule, "ok" if sql else "skipped")
        for step, table, rules, sql in _DOOMED
        for rule in rules
    ]
    return entries


def _cleanup_report() -> str:
    catalog = ", ".join(
        f"({i}, '{s}', '{t}', '{r}', '{st}')"
        for i, (s, t, r, st) in enumerate(_report_order(), start=1)
    )
    counts = " union all ".join(
        f"""select '{s}' as step, '{t}' as "table", rule, count(*) as n, sum(bytes) as b
            from ({sql}) group by rule"""
        for s, t, _, sql in _DOOMED
        if sql
    )
    query = f"""
    select cast(c.seq as bigint) as seq, c.step, c."table", c.rule, coalesce(n, 0) as "rows",
           cast(coalesce(b, 0) as bigint) as bytes,
           case when c.status = 'skipped' then 'skipped' when n is null then 'none' else 'ok' end as status
    from (values {catalog}) c(seq, step, "table", rule, status)
    left join ({counts}) k on k.step = c.step and k."table" = c."table" and k.rule = c.rule"""
    return with_views(*_CLEANUP_VIEWS, **_cleanup_parts(), query=query)


def _cleanup_doomed() -> str:
    query = " union all ".join(
        f"""select '{t}' as "table", cast(id as varchar) as id, '{s}' as step, rule from ({sql})"""
        for s, t, _, sql in _DOOMED
        if sql
    )
    return with_views(*_CLEANUP_VIEWS, **_cleanup_parts(), query=query)


def _cleanup_unlinks() -> str:
    query = """
    select path, 'ghost' as reason, max(size) as bytes from gone_registry1 group by path
    union all
    select d.path, a.action as reason, d.length as bytes from disk2 d join actions a
    using (contenthash) where a.action in ('backup', 'draft')"""
    return with_views(*_CLEANUP_VIEWS, **_cleanup_parts(recheck=False), query=query)


# --- all of them ----------------------------------------------------------------------


UPSERTED = """
            select r.id, r.path, case when g.path is null then r.mime else 'application/octet-stream' end as mime,
                   coalesce(g.length, r.size) as size,
                   case when g.path is null then 'untouched' else 'updated' end as change
            from registry r left join ghosts g on g.path = r.path
            union all
            select (select max(id) from registry)
                   + row_number() over (order by substr(md5(path), 1, 3), path) as id,
                   path, 'application/octet-stream' as mime, length as size, 'inserted' as change
            from ghosts g where not exists (select 1 from registry r where r.path = g.path)"""


def oracle_sql() -> dict[str, str]:
    backup_all = "first_backup is not null"
    found_by_size = f"select path, 'text/plain' as mime, length as size from ({GHOSTS})"
    submissions = """select count(*) as n_files, cast(coalesce(sum(filesize), 0) as bigint) as n_bytes
        from files where component = 'assignsubmission_file' and timecreated"""
    backup_safe = "(first_backup is not null and n_backups = n)"
    return {
        "cleanup_report": _cleanup_report(),
        "cleanup_doomed": _cleanup_doomed(),
        "cleanup_unlinks": _cleanup_unlinks(),
        "logs_orphan_or_aged": with_views(
            "log", "context", query=_orphan_or_aged("log", "context", "contextid", "timecreated", LC)
        ),
        "analytics_logs_orphan_or_aged": with_views(
            "analytics_log",
            "context",
            query=_orphan_or_aged(
                "analytics_log", "context", "contextid", "timecreated", A - 500 * DAY
            ),
        ),
        "grade_items_deleted_courses": with_views(
            "gi", "course", query=_missing("gi", "course", "courseid", "t.courseid is not null")
        ),
        "grade_items_deleted_modules": with_views("gi", "cm", query=DELETED_MODULE),
        "grade_items_first_rule": with_views(
            "gi",
            "cm",
            "course",
            query=_first(
                ("deleted_course", _missing("gi", "course", "courseid", "t.courseid is not null")),
                ("deleted_module", DELETED_MODULE),
            ),
        ),
        "grade_grades_orphan_items": with_views("gg", "gi", query=_missing("gg", "gi", "itemid")),
        "grade_grades_deleted_users": with_views(
            "gg", "grader", query=_missing("gg", "grader", "userid")
        ),
        "grade_categories_deleted_courses": with_views(
            "gc", "course", query=_missing("gc", "course", "courseid")
        ),
        "grade_outcomes_deleted_courses": with_views(
            "grade_outcomes", "course", query=_missing("grade_outcomes", "course", "courseid")
        ),
        "grade_outcomes_sparing_nulls": with_views(
            "gc", "course", query=_missing("gc", "course", "courseid", "t.courseid is not null")
        ),
        "grade_history_orphan_or_aged": with_views(
            "ggh", "gi", query=_orphan_or_aged("ggh", "gi", "itemid", "timemodified", HC)
        ),
        "component_retention": with_views(
            "files",
            query=f"""select id, component, timecreated from files
            where component in ('assignsubmission_file', 'backup') and timecreated < {COMPONENT_CUT}""",
        ),
        "course_modules_orphans": with_views(
            "cm",
            "course",
            query=f"""select id, course, module, inst as instance, section, deletioninprogress
            from ({ORPHAN_CM})""",
        ),
        "stalled_tasks": with_views(
            "task", stalled=STALLED, query="select id, faildelay, timestarted from stalled"
        ),
        "stalled_task_modules": with_views(
            "task", "cm", "modules", stalled=STALLED, query=TASK_MODULES
        ),
        "stalled_task_resolution": with_views(
            "task", "cm", "modules", stalled=STALLED, task_modules=TASK_MODULES, query=TASK_OUTCOMES
        ),
        "module_tags": _by_module(
            "t.component = 'core' and t.itemtype = 'course_modules' and t.itemid = d.id"
        ),
        "module_content_tags": _by_module(
            "t.component = 'mod_' || d.module_name and t.contextid = d.contextid"
        ),
        "module_rows_by_context": _by_module("t.contextid = d.contextid"),
        "module_rows_by_module": _by_module("t.itemid = d.id"),
        "stalled_tasks_with_sections": with_views(
            "task", "cm", "course", "modules", "sections",
            stalled=STALLED, cm1=LEFT_CM, task_modules=LISTED_TASK_MODULES,
            query=TASK_OUTCOMES.replace("= 'failed'", "in ('failed', 'unlisted')"),
        ),
        "sections_after_cleanup": with_views(
            "task", "cm", "course", "modules", "sections",
            stalled=STALLED, cm1=LEFT_CM, task_modules=LISTED_TASK_MODULES,
            gone=f"""
                select c.id, c.section from cm c where c.id not in (select id from cm1)
                union select c.id, c.section from cm c join task_modules t on t.module_id = c.id
                where t.outcome in ('deleted', 'unlisted')""",
            query="""
            select s.id, coalesce(string_agg(p.x, ',' order by p.x_at) filter (g.id is null), '')
                   as "sequence"
            from sections s
            left join (select id as sid, unnest(string_split("sequence", ',')) as x,
                         generate_subscripts(string_split("sequence", ','), 1) as x_at
                       from sections) p on p.sid = s.id
            left join gone g on g.section = s.id and cast(g.id as varchar) = p.x
            group by s.id""",
        ),
        "module_cascade_context": _cascade("context"),
        "module_cascade_files": _cascade("files"),
        "module_cascade_events": _cascade("event", "t.id, t.inst as instance, t.modulename"),
        "module_cascade_grade_items": _cascade("grade_items"),
        "module_cascade_completion": _cascade("course_modules_completion"),
        "module_cascade_viewed": _cascade("course_modules_viewed"),
        "module_cascade_criteria": _cascade("course_completion_criteria"),
        "module_tombstones": with_views(
            *DOOMED_VIEWS,
            lost=ORPHAN_CM,
            doomed=DOOMED_CM,
            query="""select course as courseid, contextid, id as objectid, module_name as modulename,
                inst as instanceid, cast(to_json({'id': id, 'course': course, 'module': module,
                'instance': inst, 'section': section, 'deletioninprogress': deletioninprogress})
                as varchar) as snapshot from doomed""",
        ),
        "requeue_tasks": with_views("cm", query=_requeue("0")),
        "requeue_tasks_in_blocks": with_views(
            "cm", query=_requeue("cast(floor(id / 3.0) as bigint)")
        ),
        "tasks_after_requeue": with_views(
            "task", query=f"select id, classname from task where classname <> '{views.DELETE_TASK}'"
        ),
        "scan_ghosts": with_views("disk", "files", query=GHOSTS),
        "ghost_scan_bytes": with_views(
            "disk",
            "files",
            query=f"""select count(*) as n_files, cast(coalesce(sum(length), 0) as bigint) as n_bytes,
            round(coalesce(sum(length), 0) / {1024.0**3}, 3) as n_gib from ({GHOSTS})""",
        ),
        "upsert_registry": with_views("disk", "files", "registry", ghosts=GHOSTS, query=UPSERTED),
        "registry_in_buckets": with_views(
            "disk", "files", "registry", ghosts=GHOSTS, query=f"select id, path, mime, size from ({UPSERTED})"
        ),
        "registry_presence": with_views(
            "registry",
            "disk",
            query="""select id, path, exists (
            select 1 from disk d where d.path = r.path) as present from registry r""",
        ),
        "requeued_task_table": with_views(
            "task",
            "cm",
            fresh=_requeue("0"),
            query=f"""
            select id, classname, faildelay, timestarted, customdata
            from task where classname <> '{views.DELETE_TASK}'
            union all
            select (select max(id) from task)
                   + row_number() over (order by substr(md5(customdata), 1, 3), customdata),
                   classname, 0, null, customdata from fresh""",
        ),
        "ghosts_still_unlinked": with_views(
            "files", "registry", query=_anti_hash("registry", "files")
        ),
        "ghost_report_page0": with_views(
            "registry",
            query=f"""select path, mime, size, round(size / {1024.0**2}, 1) as size_mib
            from registry order by size desc, path limit 250""",
        ),
        "ghost_totals": with_views(
            "registry",
            query=f"""select count(*) as n_files, cast(sum(size) as bigint) as n_bytes,
            round(sum(size) / {1024.0**3}, 3) as n_gib from registry""",
        ),
        "ghost_downloads": with_views(
            "registry",
            query="""select path, '/data/' || path as location, split_part(path, '/', 4) as name
            from registry""",
        ),
        "sniff_mime": f"""
            select 'page' as kind, page_id as id, {_mime("html")} as mime from pages
            union all
            select 'document' as kind, doc_id as id, {_mime("text")} as mime from documents""",
        "content_presence": with_views(
            "files",
            "disk",
            query="""select id, contenthash, exists (
            select 1 from disk d where d.contenthash = f.contenthash) as present from files f""",
        ),
        "files_checkout": _checkout(ACTIONS),
        "files_checkout_safe": _checkout(SAFE_ACTIONS),
        "checkout_doomed": _checkout(
            f"""select a.id, a.contenthash, a.action, f.filesize as bytes
            from ({ACTIONS}) a join files f on f.id = a.id where a.action <> 'keep'"""
        ),
        "checkout_unlinks": _checkout(UNLINKS.format(backup=backup_all)),
        "checkout_unlinks_safe": _checkout(UNLINKS.format(backup=backup_safe)),
        "remove_by_file": with_views(
            "files",
            query="""select id, contenthash, filename from files where contenthash in (
            select f.contenthash from files f join labels l on l.doc_id = f.id where l.toxic = 1)""",
        ),
        "removal_summary": with_views(
            "files",
            "disk",
            query=f"""
            select l.doc_id as id, f.filename as name, f.filesize / {1024.0**2} as size_mib,
                   round(f.filesize / {1024.0**2}, 2) as size_shown, coalesce(n.n, 0) as n_records,
                   case when f.id is null then 'not_found' when exists (
                     select 1 from disk d where d.contenthash = f.contenthash)
                     then 'content' else 'record_only' end as status
            from labels l left join files f on f.id = l.doc_id
            left join (select contenthash, count(*) as n from files group by contenthash) n
              on n.contenthash = f.contenthash
            where l.toxic = 1""",
        ),
        "resolve_links": with_views(
            "files",
            "context",
            "cm",
            query="""
            select id, status,
                   case status when 'restore' then '/backup/restorefile.php?contextid=' || contextid
                     when 'section' then '/course/view.php?id=' || course || '#module-' || cm_id
                     when 'view' then '/mod/' || replace(component, 'mod_', '') || '/view.php?id=' || cm_id
                   end as view_url,
                   '/' || contextid || '/' || component || '/' || filearea || '/' || itemid
                     || filepath || filename as download_path,
                   filename as download_name
            from (select f.*, m.course, m.id as cm_id,
                    case when component = 'backup' and filearea = 'course' then 'restore'
                         when x.id is null then 'nocontext'
                         when x.contextlevel <> 70 then 'unknowncontext'
                         when m.id is null then 'nomodule'
                         when component = 'mod_resource' then 'section' else 'view' end as status
                  from files f left join context x on x.id = f.contextid
                  left join cm m on m.id = x.instanceid and x.contextlevel = 70)""",
        ),
        "find_files_50mb": with_views(
            "files",
            "usr",
            query=_found(f"f.filesize > {50 * MIB}", FILE_COLUMNS, "order by contenthash limit 50"),
        ),
        "find_files_50mb_page1": with_views(
            "files",
            "usr",
            query=_found(
                f"f.filesize > {50 * MIB}", FILE_COLUMNS, "order by contenthash limit 20 offset 20"
            ),
        ),
        "find_files_page_by_ranges": with_views(
            "files",
            "usr",
            query=_found(
                f"f.filesize > {50 * MIB}", FILE_COLUMNS, "order by contenthash limit 20 offset 20"
            ),
        ),
        "task_payloads": with_views(
            "task",
            parsed="""select id, customdata, case when json_valid(customdata) then customdata::json end as doc
            from task""",
            listed="""select id, unnest(list_concat(coalesce(json_extract(doc, '$.cms[*]'), []),
              coalesce(json_extract(doc, '$.cms.*'), []))) as e from parsed""",
            query="""
            select t.id as task_id, try_cast(json_extract_string(e, '$.id') as bigint) as module_id,
                   case when customdata is null then 'no payload' when doc is null then 'not JSON'
                        when json_extract(doc, '$.cms') is null then 'no modules'
                        when json_type(doc, '$.cms') not in ('ARRAY', 'OBJECT') then 'modules of another type'
                        when e is null then 'empty list'
                        when json_extract_string(e, '$.id') is null then 'no id'
                        when try_cast(json_extract_string(e, '$.id') as bigint) is null then 'id is no number'
                   end as reason
            from parsed t left join listed l on l.id = t.id""",
        ),
        "cleanup_own_rules": with_views(
            "files",
            "usr",
            "gc",
            drafts="select * from files where filearea = 'draft' and filesize > 20000000",
            nobody="""select * from files f where not exists (select 1 from usr u where u.id = f.userid)
            and not exists (select 1 from drafts d where d.id = f.id)""",
            counted="""
            select 1 as seq, 'large_drafts' as step, 'files' as "table", count(*) as n, sum(filesize) as b from drafts
            union all select 2, 'of_nobody', 'files', count(*), sum(filesize) from nobody
            union all select 3, 'no_course', 'grade_categories', count(*), 0 from gc where courseid is null
            union all select 4, 'absent_table', 'blog', 0, 0""",
            query="""select seq, step, "table", step as rule, n as rows, cast(coalesce(b, 0) as bigint) as bytes,
            case when "table" = 'blog' then 'skipped' when n = 0 then 'none' else 'ok' end as status from counted""",
        ),
        "stored_bytes": with_views(
            "log",
            query=f"""
            select 'logstore_standard_log' as item, period, n_rows as n, true as of_the_files
            from ({_history("logstore_standard_log", "log", "timecreated", A)})""",
        ),
        "file_page_listing": with_views(
            "files",
            "usr",
            query=_found(f"f.filesize > {50 * MIB}", LISTING, "order by contenthash limit 50"),
        ),
        "find_files_user": with_views(
            "files",
            "usr",
            query=_found(
                f"f.filesize > {20 * MIB} and u.deleted = 1 and {USER_LIKE}",
                "id, contenthash, filename, user_deleted, firstname, lastname",
            ),
        ),
        "find_files_listing": with_views(
            "files",
            "usr",
            query=_found(
                "f.filesize > 0 and f.component = 'backup' and f.filename like '%_1%'",
                LISTING,
            ),
        ),
        "count_files_50mb": with_views("files", "usr", query=_count(f"f.filesize > {50 * MIB}")),
        "count_files_user": with_views(
            "files", "usr", query=_count(f"f.filesize > 0 and {USER_LIKE}")
        ),
        "file_stats_by_component": with_views("files", query=_file_stats()),
        "component_stats_year_before": with_views(
            "files",
            query=f"""select count(*) as n_files, cast(coalesce(sum(filesize), 0) as bigint) as n_bytes
            from files where component = 'backup' and timemodified >= {Y2} and timemodified < {Y1}""",
        ),
        "history_stats": with_views(
            "log",
            "analytics_log",
            query=_history("logstore_standard_log", "log", "timecreated", views.LOG_AS_OF)
            + " union all "
            + _history(
                "logstore_lanalytics_log",
                "analytics_log",
                "timecreated",
                views.LOG_AS_OF,
                "7000000.0",
            )
            + " union all select 'grade_items_history', null, null, null, 'skipped'",
        ),
        "grade_history_stats": with_views(
            "ggh",
            query=_history("grade_grades_history", "ggh", "timemodified", views.GRADE_AS_OF),
        ),
        "usage_statistics": with_views(
            "files",
            "log",
            "analytics_log",
            "ggh",
            query=_usage(
                "files", ("logstore_standard_log", "log", "timecreated"),
                ("logstore_lanalytics_log", "analytics_log", "timecreated"),
                ("grade_grades_history", "ggh", "timemodified"), ("grade_items_history", None, None),
            ),
        ),
        "usage_from_rollup": with_views(
            "files",
            "log",
            "analytics_log",
            "context",
            live_files=f"""select * from files where component not in ('assignsubmission_file', 'backup')
            or timecreated >= {COMPONENT_CUT}""",
            live_log=f"""select t.* from log t where timecreated >= {LC}
            and exists (select 1 from context p where p.id = t.contextid)""",
            query=_usage(
                "live_files", ("logstore_standard_log", "live_log", "timecreated"),
                ("logstore_lanalytics_log", "analytics_log", "timecreated"),
                ("grade_grades_history", None, None), ("grade_items_history", None, None),
            ),
        ),
        "cascade_fixpoint": with_views(
            "usr", "course", "cm", "gi", "context", "files", "gg", "completion", "category_tree",
            query=_fixpoint(),
        ),
        "apply_deletes_survivors": LOG_SURVIVORS,
        **{
            name: LOG_SURVIVORS
            for name in ("log_survivors_by_vectors", "log_survivors_after_rewrite", "log_survivors_by_footers")
        },
        "files_rewrite_manifest": with_views(
            "files",
            query=f"""
            select component, count(*) as rows, count(*) filter (gone) as deleted,
                   case when count(*) filter (gone) = 0 then 'kept'
                        when count(*) filter (not gone) = 0 then 'dropped' else 'rewritten' end as action
            from (select *, component in ('assignsubmission_file', 'backup')
                         and timecreated < {COMPONENT_CUT} as gone from files)
            group by component""",
        ),
        "log_months_by_age": with_views(
            "log",
            query=f"""
            select verdict, count(*) as files, cast(sum(n) as bigint) as rows
            from (select count(*) as n, case when max(timecreated) < {LC} then 'aged'
                           when min(timecreated) >= {LC} then 'fresh' else 'mixed' end as verdict
                  from log group by strftime(to_timestamp(timecreated) at time zone 'UTC', '%Y-%m'))
            group by verdict""",
        ),
        "delete_by_predicate_survivors": with_views(
            "gi", query="select id, itemtype from gi where itemtype is distinct from 'mod'"
        ),
        "drafts_past_lifetime": with_views(
            "files",
            query=f"""select id, timecreated from files
            where filearea = 'draft' and timecreated <= {DRAFT_CUT}""",
        ),
        "cleanup_report_checkout_only": _checkout(f"""
            select cast(c.seq as bigint) as seq, 'files_checkout' as step, 'files' as "table", c.rule,
                   count(a.id) as "rows", cast(coalesce(sum(f.filesize), 0) as bigint) as bytes,
                   case when count(a.id) = 0 then 'none' else 'ok' end as status
            from (values (1, 'missing'), (2, 'content_gone'), (3, 'backup'), (4, 'draft')) c(seq, rule)
            left join ({ACTIONS}) a on a.action = c.rule left join files f on f.id = a.id
            group by c.seq, c.rule"""),
        "find_files_after_hash": with_views(
            "files",
            "usr",
            query=_found(
                f"f.filesize > {10 * MIB} and f.contenthash > '8'",
                FILE_COLUMNS,
                "order by contenthash limit 50",
            ),
        ),
        "ghost_report_after": with_views(
            "disk",
            "files",
            query=f"""select path, mime, size, round(size / {1024.0**2}, 1) as size_mib
            from ({found_by_size}) where size < 1500 or (size = 1500 and path > 'filedir/8')
            order by size desc, path limit 250""",
        ),
        "backups_past_lifetime": with_views(
            "files",
            query=f"""select id, filename, timecreated from files
            where filename like '%.mbz' and timecreated <= {BACKUP_CUT}""",
        ),
        "component_stats_last_year": with_views("files", query=f"{submissions} > {Y1}"),
        "component_stats_older": with_views("files", query=f"{submissions} < {Y1}"),
        "file_sizes": with_views(
            "files",
            query=f"""select id, {_shown("filesize")} as shown,
            round(filesize / {1024.0**2}, 1) as size_mib,
            round(filesize / {1024.0**3}, 3) as size_gib from files""",
        ),
    }
