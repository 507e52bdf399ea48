"""All queries over the driver's tables: importing their modules registers them."""

from actispark.plans import clinic, jobs, models, motion, nightly, stored  # noqa: F401
from actispark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
