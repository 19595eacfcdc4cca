"""Write COVERAGE.md: inventory id -> function -> registered queries. python tools/coverage.py"""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from adloom.plans.catalog import load_all  # noqa: E402

WHERE = """
SRC-01 sources.tables.read_table
SRC-02 sources.landed.land_campaign_spend
SRC-03 sources.landed.filter_active_accounts
SRC-04 sources.landed.read_advertiser_stats_landed
SRC-05 sources.landed.filter_advertiser_access
SRC-06 functions.scalars.parse_money
SRC-07 sources.landed.active_days
SRC-08 sources.landed.target_dates
SRC-09 sources.landed.read_ad_policy_landed
SRC-10 sources.landed.read_call_assets_landed
SRC-11 sources.landed.read_billing_landed
SRC-12 sources.landed.list_child_accounts
SRC-13 sources.sheets.materialize_sheet
SRC-14 sources.sheets.read_committed_sheet
SRC-15 sources.payloads.normalize_payload
SRC-16 sources.payloads.read_triage_items
SNK-01 sinks.tables.replace_range
SNK-02 sinks.tables.merge_upsert
SNK-03 sinks.tables.load_staging
SNK-04 sinks.tables.ensure_table
SNK-05 sinks.tables.append_event
SNK-06 sinks.tables.append_tombstones
SNK-07 sinks.registry.update_where
SNK-08 sinks.registry.insert_if_absent
SNK-09 sinks.registry.replace_children
SNK-10 sinks.registry.delete_guarded
SNK-11 sinks.registry.dedupe_seed
SNK-12 sinks.tables.accumulate_snapshot
FLT-01 operators.attribution.voice_calls
FLT-02 operators.attribution.channel
FLT-03 operators.attribution.method
FLT-04 operators.attribution.gclid
FLT-05 operators.attribution.flags
FLT-06 operators.alerts.latest_partition
FLT-07 operators.alerts.latest_snapshot
FLT-08 operators.alerts.enabled_not_local
FLT-09 operators.alerts.not_ok
FLT-10 functions.scalars.since
FLT-11 operators.leads.window_start
FLT-12 operators.leads.managed_only
FLT-13 operators.pacing.exclude_client_paid
FLT-14 operators.board.alert_filter
FLT-15 operators.board.av_bucket
FLT-16 operators.budget.budget_filter
FLT-17 operators.registry.filter_standards
FLT-18 operators.board.is_new
FLT-19 operators.budget.validate_event
FLT-20 operators.registry.validate_rule
FLT-21 operators.registry.validate_standard
FLT-22 operators.access.validate_change
FLT-23 operators.budget.validate_tombstones
FLT-24 operators.budget.large_change
FLT-25 operators.diagnosis.campaign_type
FLT-26 operators.spend.rolling_months
PRJ-01 operators.board.normalize_alerts
PRJ-02 operators.calls.ads_daily
PRJ-03 operators.pacing.coerce_pacing_rows
PRJ-04 functions.scalars.label_of
PRJ-05 operators.calls.hour_label
PRJ-06 operators.spend.source_group
JN-01 operators.attribution.with_client
JN-02 operators.leads.monthly_spend
JN-03 operators.alerts.ads_disapproved
JN-04 operators.alerts.with_mapping
JN-05 operators.heatmap.client_heatmap
JN-06 operators.pacing.pacing_api
JN-07 operators.leads.merge_spend_and_leads
JN-08 operators.calls.ads_per_day
JN-09 operators.budget.live_events
JN-10 sinks.registry.delete_guarded
JN-11 operators.heatmap.client_zips
JN-12 operators.registry.rule_registry
JN-13 operators.spend.join_by_normalized_name
JN-14 operators.spend.resolve_client
JN-15 operators.access.user_access
JN-16 operators.diagnosis.negative_conflicts
AGG-01 operators.spend.spend_trailing
AGG-02 operators.spend.conversions_trailing
AGG-03 operators.heatmap.zip_footprint
AGG-04 operators.pacing.committed_by_month
AGG-05 operators.alerts.disapproved_per_campaign
AGG-06 operators.alerts.spend_status
AGG-07 operators.alerts.url_problems
AGG-08 operators.leads.monthly_spend
AGG-09 operators.leads.monthly_leads
AGG-10 operators.budget.budget_matrix
AGG-11 operators.budget.budget_summary
AGG-12 operators.budget.client_totals
AGG-13 operators.pacing.month_pacing
AGG-14 operators.pacing.year_pacing
AGG-15 operators.pacing.channel_breakdown
AGG-16 operators.pacing.pacing_overview
AGG-17 operators.pacing.year_pacing_managed
AGG-18 operators.pacing.status_actual
AGG-19 operators.calls.call_cards
AGG-20 operators.calls.calls_by_channel
AGG-21 operators.calls.calls_by_day_channel
AGG-22 operators.calls.missed_by_channel
AGG-23 operators.calls.ads_daily_table
AGG-24 operators.calls.dow_hour_grid
AGG-25 operators.calls.calls_daily
AGG-26 operators.calls.calls_heatmap
AGG-27 operators.leads.cpl_summary
AGG-28 operators.board.alert_metrics
AGG-29 operators.board.alert_by_type
AGG-30 operators.board.alert_by_manager
AGG-31 operators.registry.rule_summary
AGG-32 operators.registry.registry_summary
AGG-33 operators.roadmap.roadmap_counts
AGG-34 operators.roadmap.stage_progress
AGG-35 operators.roadmap.owner_counts
AGG-36 operators.budget.source_mix
AGG-37 operators.diagnosis.qualified_calls
AGG-38 operators.diagnosis.portfolio_medians
AGG-39 operators.diagnosis.account_type_daily
AGG-40 operators.diagnosis.waste_by_cause
AGG-41 operators.diagnosis.masked_spend
AGG-42 operators.diagnosis.verification
AGG-43 operators.diagnosis.spend_weighted
AGG-44 operators.diagnosis.relevant_ctr
AGG-45 operators.diagnosis.classifier_audit
AGG-46 operators.diagnosis.ad_strength_share
AGG-47 operators.changes.daily_touches
WIN-01 operators.attribution.with_caller_history
WIN-02 operators.attribution.with_caller_history
WIN-03 functions.keyed.latest_per_key
WIN-04 operators.registry.current_versions
WIN-05 operators.leads.mom_trend
WIN-06 operators.leads.latest_vs_previous
WIN-07 operators.pacing.rollover
WIN-08 operators.budget.latest_budget_event
WIN-09 functions.keyed.share_of_max
WIN-10 operators.triage.status_streak
WIN-11 operators.changes.trailing_baseline
WIN-12 operators.changes.weekly_checks
WIN-13 operators.diagnosis.days_since_last_conversion
WIN-14 operators.diagnosis.vs_portfolio
SRT-01 operators.board.feed_order
SRT-02 operators.board.board_order
SRT-03 operators.leads.most_expensive_first
SRT-04 functions.scalars.rank_in
SRT-05 operators.registry.cards_feed
SRT-06 operators.budget.sort_by
SRT-07 operators.budget.event_history
SRT-08 operators.board.page
SRT-09 operators.board.alert_by_manager
SRT-10 operators.diagnosis.worst_ads
SET-01 operators.alerts.alerts_active
SET-02 operators.calls.client_universe
SET-03 operators.leads.months_present
SET-04 operators.spend.spend_union
SET-05 operators.tickets.union_boards
SET-06 operators.quality.ids_missing
OP-01 operators.attribution.calls_attribution
OP-02 operators.leads.cost_per_lead
OP-03 operators.leads.cpl
OP-04 operators.heatmap.client_heatmap
OP-05 operators.heatmap.cpa_by_client
OP-06 operators.pacing.pacing_api
OP-07 operators.pacing.pacing_status
OP-08 operators.pacing.year_status
OP-09 operators.pacing.pacing_context
OP-10 operators.alerts.campaign_suspended
OP-11 operators.alerts.ads_disapproved
OP-12 operators.alerts.overspend
OP-13 operators.alerts.overspend_forecast
OP-14 operators.alerts.no_spend
OP-15 operators.alerts.url_disapproved
OP-16 operators.alerts.phone_disapproved
OP-17 operators.alerts.billing_problem
OP-18 operators.calls.call_dashboard
OP-19 operators.budget.event_history
OP-20 operators.budget.expand_month_range
OP-21 operators.budget.budget_base_current
OP-22 operators.spend.spend_daily_unified
OP-23 operators.spend.actual_spend_all
OP-24 operators.pacing.pacing_live
OP-25 operators.pacing.target_with_catchup
OP-26 operators.pacing.daily_recommendation
OP-27 operators.pacing.capture_status
OP-28 operators.triage.campaign_triage
OP-29 operators.triage.triage_summary
OP-30 operators.tickets.ticket_board
OP-31 operators.registry.rule_registry
OP-32 operators.roadmap.roadmap_schedule
OP-33 operators.access.user_access
OP-34 operators.access.permissions
OP-35 operators.access.legacy_access
OP-36 operators.access.capability_diff
OP-37 operators.access.audit_view
OP-38 operators.verdicts.evaluate_rules
OP-39 operators.verdicts.trust_void
OP-40 operators.verdicts.account_state
OP-41 operators.diagnosis.account_snapshot
OP-42 operators.changes.change_window_check
OP-43 operators.diagnosis.budget_capped
OP-44 operators.diagnosis.upsell_headroom
OP-45 operators.spend.crosswalk_from_mapping
STR-01 operators.attribution.with_signals
STR-02 operators.attribution.flags
STR-03 functions.scalars.extract
STR-04 operators.alerts.text
STR-05 functions.scalars.digits
STR-06 operators.heatmap.client_zips
STR-07 operators.roadmap.roadmap_schedule
STR-08 operators.attribution.with_caller_history
STR-09 functions.scalars.slug
STR-10 functions.scalars.month_key
STR-11 functions.scalars.money_text
STR-12 functions.scalars.impression_share
NUL-01 operators.attribution.with_client
NUL-02 functions.scalars.normalize_id
NUL-03 functions.scalars.ratio
NUL-04 functions.scalars.number_or_zero
DT-01 operators.calls.calls_heatmap
DT-02 functions.scalars.clock_hour
DT-03 operators.attribution.with_local_time
DT-04 operators.attribution.with_caller_history
DT-05 functions.scalars.whole_days_between
DT-06 operators.leads.window_start
DT-07 functions.scalars.epoch_text
DT-08 operators.pacing.month_dims
MTH-01 functions.scalars.whole_text
MTH-02 functions.scalars.parse_money
MTH-03 functions.scalars.from_micros
ARR-01 functions.scalars.add_element
ARR-02 functions.scalars.has_capability
JSN-01 sources.payloads.payload_items
STM-01 streaming.jobs.stream_events
STM-02 streaming.jobs.stream_tombstones
STM-03 streaming.pulls.apply_pulls
STM-04 streaming.jobs.stream_audit
STM-05 streaming.jobs.stream_calls_upsert
Q-01 operators.quality.fanout_check
Q-02 operators.quality.duplicate_keys
Q-03 operators.quality.suppressed_rows
Q-04 operators.quality.parity
Q-05 operators.quality.channel_coverage
Q-06 operators.quality.required_columns
Q-07 operators.quality.data_gap
"""


def main() -> None:
    lines = ["# Coverage", "", "Inventory id, function below `adloom`, and the registered queries that exercise it.", "",
             "| id | function | queries |", "| --- | --- | --- |"]
    catalog = load_all()
    for row in WHERE.split("\n"):
        if not row:
            continue
        ident, target = row.split()
        module, _, name = target.rpartition(".")
        found = importlib.import_module(f"adloom.{module}")
        assert hasattr(found, name), target
        names = [q.name for q in catalog.values() if ident in q.covers]
        assert names, ident
        lines.append(f"| {ident} | `{target}` | {', '.join(f'`{n}`' for n in names)} |")
    (ROOT / "COVERAGE.md").write_text("\n".join(lines) + "\n")
    print(len(lines) - 6, "ids,", len(catalog), "queries")


if __name__ == "__main__":
    main()
