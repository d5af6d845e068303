"""All registered queries; importing a module registers its queries."""

from varuvakt.plans.queries import crawl, files, prices, search, selections, stats, streams, texts, upload_flow  # noqa: F401
