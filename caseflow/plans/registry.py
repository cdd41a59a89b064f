"""All registered queries and oracle SQL texts (importing the catalog modules registers them)."""

from caseflow.plans import catalog  # noqa: F401
from caseflow.plans import catalog_relational  # noqa: F401
from caseflow.plans import catalog_docs  # noqa: F401
from caseflow.plans import catalog_text  # noqa: F401
from caseflow.plans import catalog_ml  # noqa: F401
from caseflow.plans.catalog import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
