"""Fixed vocabularies and texts. Downstream pages match on them, so they must not drift."""

# ---- fixed values: call attribution -------------------------------------------------
TEXT_MESSAGE_STATUSES = [
    "sent", "delivered", "received", "undelivered",
    "delivery_failed", "unsent", "sending_failed", "queued",
]
GOOGLE_CLICK_ID = r"[?&](gclid|gbraid|wbraid)="
MICROSOFT_CLICK_ID = r"[?&]msclkid="
GCLID_VALUE = r"[?&]gclid=([^&]+)"
URL_PATH = r"^https?://[^/]+(/[^?#]*)"
BUSINESS_PROFILE_PREFIX = "Google Business Profile"
DEDICATED_SOURCES = [
    "Google Call Asset", "Google Ads", "Google Adwords", "Google Organic", "Bing Paid",
    "Nextdoor", "Meta Ads", "Facebook Paid", "Yelp",
]
PAID_SEARCH_MEDIUMS = ["cpc", "ppc", "paid_search"]
OFFLINE_MEDIUMS = ["streaming tv", "programmatic_audio"]
TAG_CLOSED = r"\bclosed\b"
TAG_NEW_CUSTOMER = r"new customer"
TAG_SPAM = r"\bspam\b"
VOICEMAIL_BELOW_SECONDS = 20
DUPLICATE_LEAD_DAYS = 30

# ---- fixed values: call dashboard ---------------------------------------------------
CALL_CHANNELS = ["Google Ads", "Bing Ads", "Nextdoor", "Meta", "Organic / Direct", "Other"]
DAY_LABELS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
# attribution channel -> dashboard channel (reconstructed; pass another map to override)
CALL_CHANNEL_OF = {
    "google_paid": "Google Ads",
    "bing_paid": "Bing Ads",
    "nextdoor_paid": "Nextdoor",
    "meta_paid": "Meta",
    "google_organic": "Organic / Direct",
    "bing_organic": "Organic / Direct",
    "gbp": "Organic / Direct",
    "direct": "Organic / Direct",
}

# ---- fixed values: spend channels ---------------------------------------------------
CHANNEL_LABELS = {
    "google_ads": "Google Ads",
    "lsa": "LSA",
    "bing": "Bing",
    "meta": "Meta",
    "nextdoor": "Nextdoor",
    "yelp": "Yelp",
}

# ---- fixed values: capture statuses and their severities ----------------------------
CAPTURE_PAUSED = "Paused (Historical)"
CAPTURE_GAP = "BQ Data Gap"
CAPTURE_OVER_REPORTED = "Captured Mismatch (AM Over-reported)"
CAPTURE_UNDER_REPORTED = "Captured Mismatch (AM Under-reported)"
CAPTURE_MISMATCH = "Captured Mismatch (>10% diff)"
CAPTURE_MATCH = "Historical Match"
CAPTURE_SEVERITY = {
    CAPTURE_PAUSED: "Healthy",
    CAPTURE_GAP: "Neutral",
    CAPTURE_OVER_REPORTED: "Review",
    CAPTURE_UNDER_REPORTED: "Critical",
    CAPTURE_MISMATCH: "Review",
    CAPTURE_MATCH: "Healthy",
}

# ---- fixed values: alerts -----------------------------------------------------------
ALERT_COLUMNS = [
    "alert_type", "severity", "source", "customer_id", "client_name", "account_manager", "tier",
    "sub_mcc", "av_status", "entity_id", "entity_name", "detail", "detected_at",
]
ALERT_LABELS = {
    "campaign_suspended": "Campaign suspended",
    "ads_disapproved": "Ads disapproved",
    "overspend": "Overspend",
    "no_spend": "Stopped spending",
}
UNASSIGNED = "(Unassigned)"
AV_APPROVED = "AV Approved"
URL_TOPICS = "DESTINATION_NOT_WORKING|DESTINATION_NOT_ACCESSIBLE"
OK_BILLING_STATUSES = ["APPROVED", "UNKNOWN"]
# alert texts: fragments around the inserted values
SUSPENDED_TEXT = (
    'Campaign "',
    '" is ENABLED but Google has it SUSPENDED (not serving). '
    "The AM expects it running; Google blocked it. Review the account for the suspension reason.",
)
DISAPPROVED_TEXT = (
    ' disapproved ad(s) in ENABLED campaign "',
    '". These ads are not serving. Review and fix policy issues.',
)
OVERSPEND_TEXT = (
    'Account "', '" (', ") is overpacing: ", "% of budget, forecast ", " vs budget ", ".",
)
NO_SPEND_TEXT = (
    'Account "', '" (', ") stopped spending: last spend ", " (",
    " days ago). Was active before. Check billing/campaigns.",
)
URL_TEXT = (
    " ad(s) disapproved for landing-page problem (", ') in campaign "',
    '". The destination URL is broken. Fix the URL.',
)
PHONE_TEXT = (
    "Phone number ",
    " is DISAPPROVED by Google. Calls from ads may not connect. Review the call asset.",
)
BILLING_TEXT = (
    "Billing problem: billing setup is ", ", account budget is ",
    ". Payment may have failed (e.g. card declined). Check billing immediately.",
)

# ---- fixed values: budgets ----------------------------------------------------------
EVENT_TYPES = ["create", "update", "delete"]
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAX_TOMBSTONES_PER_BATCH = 100

# ---- fixed values: registries -------------------------------------------------------
STANDARD_LEVELS = ["Account", "Campaign", "Ad Group", "Ad"]
STANDARD_STATUSES = ["confirmed", "pending"]
STANDARD_CATEGORIES = [
    "Data Connections", "Conversion Configuration", "Ad Assets", "Campaign Structure",
    "Keywords & Match Types", "Targeting", "Ad Copy", "Landing Pages",
]
STRATEGY_PILLARS = [
    "Keyword strategy", "Ad copy", "Bidding & budget", "Campaign structure",
    "Asset & extension strategy", "Geo / scheduling", "Landing page / conversion",
]
RULE_LEVELS = ["account", "campaign", "ad_group"]
RULE_OPERATORS = ["gt", "gte", "lt", "lte", "eq", "neq", "between"]
RULE_MATCHES = ["all", "any"]
UNRANKED = 999

# ---- fixed values: access -----------------------------------------------------------
EMAIL_PATTERN = r"(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"
CAPABILITY_PATTERN = r"^[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*$"
ROLE_PATTERN = r"^[a-z][a-z0-9_]*$"
WILDCARD = "*"
LEGACY_CAPABILITIES = {
    "admin": ["*"],
    "editor": [
        "performance.view", "budgets.view", "budgets.edit", "tickets.use", "kpi.view", "accounts.view",
    ],
    "viewer": ["performance.view", "budgets.view", "tickets.use", "kpi.view", "accounts.view"],
}

# ---- fixed values: tickets ----------------------------------------------------------
DEFAULT_STATUS_COLOR = "#c4c4c4"
DUE_DATE_COLUMN = "date4"

# ---- fixed values: validation messages, word for word (callers and the checking SQL match on them) ----
EVENT_CLIENT_REQUIRED = 'client is required'
EVENT_YEAR_INVALID = 'year must be a valid integer'
EVENT_MONTH_INVALID = 'month must be 1-12'
EVENT_AMOUNT_INVALID = 'amount must be a number'
TOMBSTONE_ID_INVALID = 'Invalid event_id'
RULE_STATUS_REQUIRED = 'status_id is required'
RULE_TEXT_REQUIRED = 'condition_text is required'
RULE_METRIC_REQUIRED = 'each condition needs a metric'
RULE_BETWEEN_HALF = "'between' needs both threshold and threshold_high"
STANDARD_FIELDS_REQUIRED = 'item_id, category, level, and item are required.'
STANDARD_STATUS_INVALID = 'status must be confirmed or pending.'
CARD_FIELDS_REQUIRED = 'card_id, pillar, title, and status are required'
ACCESS_EMAIL_REQUIRED = 'A valid email is required'
ACCESS_ROLE_INVALID = 'Invalid role'
ACCESS_CAPABILITY_INVALID = 'Invalid capability (expected modulo.accion)'
ACCESS_KEEP_ADMIN = 'This account is lockout-protected and must remain admin.'
ACCESS_KEEP_ACTIVE = 'This account is lockout-protected and cannot be deactivated.'
ACCESS_NOTHING_TO_REVOKE = 'This account is lockout-protected; nothing to revoke on admin.'
ACCESS_USER_EXISTS = 'User already exists'
ACCESS_USER_MISSING = 'No user found with that email'
