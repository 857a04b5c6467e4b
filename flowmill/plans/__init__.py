"""Named queries over the driver's tables; importing this package registers them."""

from . import bar_queries, detail_queries, flow_queries, io_queries, level_queries, panel_queries, position_queries, review_queries, rule_queries, setup_queries, surface_queries, tracker_queries  # noqa: F401
