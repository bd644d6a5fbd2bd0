"""Keys read out of task ids such as ``owner__repo-123``, and the owner-to-domain table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Owner of a repository -> domain label, and the label of every other owner.
OWNER_DOMAINS = {
    "globocom": "Web & Media Systems",
    "kayak": "Database & Query Engines",
    "jertel": "Infrastructure & Monitoring",
    "PyCQA": "Code Quality & Linters",
    "Pylons": "Web Frameworks",
    "prometheus": "Infrastructure & Monitoring",
    "patroni": "Database & Query Engines",
    "kellyjonbrazil": "CLI & Text Parsing",
    "nvbn": "Developer CLI Tools",
    "feature-engine": "Data Science & Machine Learning",
    "cantools": "Embedded Systems & Hardware",
    "movingpandas": "Data Science & Machine Learning",
    "pyro-ppl": "Data Science & Machine Learning",
    "pre-commit": "Code Quality & Linters",
    "stanfordnlp": "Data Science & Machine Learning",
    "beetbox": "Web & Media Systems",
}
DEFAULT_DOMAIN = "General Software Utilities"

# Keys of ids that name no owner or repository.
OTHER_OWNER = "Other"
FALLBACK_REPO = "mock_owner/mock_project"

_TRUE_REPO = r"^(.+?)__(.+)-([0-9]+)$"


def owner(task_id: str) -> Column:
    """The text before ``__``, else before ``_``, else ``Other``."""
    c = F.col(task_id)
    before = F.when(c.contains("__"), F.split_part(c, F.lit("__"), F.lit(1))).when(
        c.contains("_"), F.split_part(c, F.lit("_"), F.lit(1))
    )
    return _never_null(before, OTHER_OWNER)


def _never_null(key: Column, default: str) -> Column:
    """Coalesced, so that Spark sees the key is never null and pushes no test of it into the scan below a join."""
    return F.coalesce(key, F.lit(default))


def compat_repo(task_id: str) -> Column:
    """The key published repository-level figures were grouped by: first two ``_`` parts, joined by ``/``.

    For ``owner__repo-1`` the second part is empty, so this is an owner key in disguise. Use
    ``true_repo`` unless those figures must be matched.
    """
    parts = F.split(F.col(task_id), "_", -1)
    usable = (F.size(parts) > 1) & ~F.element_at(parts, -1).rlike("^[0-9]+$")
    return _never_null(F.when(usable, F.concat(parts[0], F.lit("/"), parts[1])), FALLBACK_REPO)


def true_repo(task_id: str) -> Column:
    """``owner/repo`` of ``owner__repo-123``; null where the id has another form."""
    c = F.col(task_id)
    return F.nullif(F.regexp_replace(c, _TRUE_REPO, "$1/$2"), c)


def issue_number(task_id: str) -> Column:
    """The trailing number of ``owner__repo-123``; null where the id has another form."""
    return F.expr(f"try_cast(nullif(regexp_extract(`{task_id}`, r'{_TRUE_REPO}', 3), '') AS BIGINT)")


def domain(owner_col: str, domains: Mapping[str, str] = OWNER_DOMAINS, default: str = DEFAULT_DOMAIN) -> Column:
    """Domain of an owner by a small literal map; use ``attach_domain`` when the lookup is a table."""
    pairs = [F.lit(text) for item in domains.items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(owner_col)), F.lit(default))


def padded_id(number: str, width: int = 4, prefix: str = "task_") -> Column:
    """``task_0007``; numbers longer than ``width`` keep all their digits."""
    digits = F.col(number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def base_name(path: str) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(F.col(path), "/", -1), -1)
