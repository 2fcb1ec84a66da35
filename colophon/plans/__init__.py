"""The operators bound to the driver's tables.  Importing this package fills the registry."""

from colophon.plans import discovery, feed, imaging, intake, listing, page_jobs, priority, review, second_source, streams  # noqa: F401
