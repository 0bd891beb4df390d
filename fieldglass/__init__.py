"""Earth-observation analytics as functions from DataFrame to DataFrame."""

from fieldglass.operators.anomaly import severity_distribution, with_anomaly
from fieldglass.operators.browse import browse, browse_total, health, metadata, page_after
from fieldglass.operators.cluster import clusters
from fieldglass.operators.correlation import correlation_matrix, correlations, strongest
from fieldglass.operators.counts import deviations, distinct_counts, share_of_rows, threshold_counts
from fieldglass.operators.distribution import exact_quantiles, with_percent_rank, with_row_position
from fieldglass.operators.findings import findings, first_findings, recommendations
from fieldglass.operators.histogram import density, histogram
from fieldglass.operators.pages import page_at, page_index
from fieldglass.operators.points import in_box, map_positions, matching_total, points
from fieldglass.operators.regions import index_cards, rank_regions, regional_profile, spatial_density, summary
from fieldglass.operators.reports import attach_scores, flagged, flagged_after, flagged_total, report
from fieldglass.operators.risk import risk_distribution, risk_report, with_risk
from fieldglass.operators.schema import numeric_features, prepare, resolve_fields
from fieldglass.operators.search_index import search_index, search_indexed
from fieldglass.operators.trends import (
    first_and_last,
    latest_buckets,
    moving_average,
    rolling_band,
    seasonality,
    trend,
    trend_cards,
    trend_change,
    trend_slope,
)
from fieldglass.sources.ledger import load, stored_rows
from fieldglass.sources.readers import choose_source, fingerprint, read_climate_feed, read_observations, union_stations
from fieldglass.sources.totals import kept_counts, kept_profile, kept_trend, refresh_totals
from fieldglass.sources.writers import export, materialise, stored_metadata

__all__ = [name for name in dir() if not name.startswith("_")]
