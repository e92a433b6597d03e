"""Settings of a clean-up run and of a file search."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# Class name the host application gives to its delayed module
# deletion, and the context level it gives to course modules.
MODULE_DELETE_TASK = "\\core_course\\task\\course_delete_modules"
MODULE_CONTEXT_LEVEL = 70
ACTIVITY_CRITERION = 4

DAY = 86_400

# Names under which the host application stores the settings.
SETTINGS = {
    "cleanup_items_per_page": "items_per_page",
    "cleanup_backup_timeout_days": "backup_days",
    "cleanup_draft_timeout": "draft_days",
    "cleanup_logs_timeout_days": "log_days",
    "cleanup_component_files_days": "component_file_days",
    "cleanup_grades_days": "grade_history_days",
    "cleanup_course_modules_days": "module_task_days",
    "cleanup_run_autoremove": "auto_remove",
}


@dataclass(frozen=True)
class RetentionPolicy:
    """How long each kind of data is kept, in days.

    ``auto_remove`` is the master switch of the database rules; the content
    check-out runs either way.
    """

    backup_days: int = 30
    draft_days: int = 30
    log_days: int = 500
    grade_history_days: int = 500
    component_file_days: int = 180
    components: tuple[str, ...] = ("assignsubmission_file", "backup")
    module_task_days: int = 7
    auto_remove: bool = False
    items_per_page: int = 50
    module_delete_task: str = MODULE_DELETE_TASK
    module_context_level: int = MODULE_CONTEXT_LEVEL
    activity_criterion: int = ACTIVITY_CRITERION

    @classmethod
    def from_settings(cls, stored: Mapping[str, object]) -> RetentionPolicy:
        """The policy of stored settings, which are texts. Blank and absent ones keep their default,
        settings of other names are passed over, and what is no whole number is an error."""
        given: dict[str, int | bool] = {}
        for name, field in SETTINGS.items():
            text = str(stored.get(name) if stored.get(name) is not None else "").strip()
            if not text:
                continue
            try:
                number = int(text)
            except ValueError:
                raise ValueError(f"setting {name} is no whole number: {text}") from None
            if number < 0:
                raise ValueError(f"setting {name} is below zero: {number}")
            given[field] = bool(number) if field == "auto_remove" else number
        return cls(**given)

    @staticmethod
    def cutoff(as_of: int, days: int) -> int:
        """Epoch second ``days`` whole days before ``as_of``."""
        return as_of - days * DAY


@dataclass(frozen=True)
class FileFilter:
    """Criteria of the file search; blank criteria (``""``, ``"0"``, 0, None) are ignored.

    ``min_mib`` always applies and is strict, so the default 0 still leaves out
    empty files. ``name_like`` and ``user_like`` keep ``%`` and ``_`` as wildcards.
    """

    min_mib: int = 0
    name_like: str | None = None
    user_like: str | None = None
    component: str | None = None
    user_deleted: bool | int | str | None = None
    case_sensitive: bool = True

    @staticmethod
    def given(value) -> bool:
        return bool(value) and value != "0"

    @property
    def needs_user(self) -> bool:
        return self.given(self.user_like) or self.given(self.user_deleted)
