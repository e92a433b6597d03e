"""Declared schemas of the tables the library works on. Nothing is inferred.

The strings are DDL, as ``DataFrameReader.schema`` takes it. Ids and byte sizes are bigint, times
are epoch seconds, flags are int 0/1.
"""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "files": "id bigint, contenthash string, contextid bigint, component string, "
    "filearea string, itemid bigint, filepath string, filename string, filesize bigint, "
    "userid bigint, author string, timecreated bigint, timemodified bigint",
    "user": "id bigint, firstname string, lastname string, deleted int",
    "context": "id bigint, contextlevel int, instanceid bigint",
    "course": "id bigint",
    "course_modules": "id bigint, course bigint, module bigint, instance bigint, "
    "section bigint, deletioninprogress int",
    "course_sections": "id bigint, sequence string",
    "modules": "id bigint, name string",
    "grade_items": "id bigint, courseid bigint, itemtype string, itemmodule string, "
    "iteminstance bigint",
    "grade_grades": "id bigint, itemid bigint, userid bigint",
    "grade_categories": "id bigint, courseid bigint",
    "grade_outcomes_courses": "id bigint, courseid bigint",
    "grade_grades_history": "id bigint, itemid bigint, timemodified bigint",
    "grade_items_history": "id bigint, timemodified bigint",
    "logstore_standard_log": "id bigint, contextid bigint, timecreated bigint",
    "logstore_lanalytics_log": "id bigint, contextid bigint, timecreated bigint",
    "task_adhoc": "id bigint, classname string, faildelay bigint, timestarted bigint, "
    "customdata string",
    "event": "id bigint, instance bigint, modulename string",
    "course_modules_completion": "id bigint, coursemoduleid bigint",
    "course_modules_viewed": "id bigint, coursemoduleid bigint",
    "course_completion_criteria": "id bigint, moduleinstance bigint, course bigint, "
    "criteriatype int",
    "ghost_registry": "id bigint, path string, mime string, size bigint",
    "config": "name string, value string",
    "inventory": "path string, contenthash string, length bigint",
}
