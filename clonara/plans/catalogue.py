"""All registered queries."""

from clonara.plans.registry import ORACLES, QUERIES  # noqa: F401
from clonara.plans import kmer_queries  # noqa: F401
from clonara.plans import profile_queries  # noqa: F401
from clonara.plans import clonotype_queries  # noqa: F401
from clonara.plans import report_queries  # noqa: F401
from clonara.plans import ranking_queries  # noqa: F401
from clonara.plans import source_queries  # noqa: F401
from clonara.plans import model_queries  # noqa: F401
