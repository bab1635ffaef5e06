"""Default parameters and fixed vocabularies. Operators take them as arguments; nothing here reads the environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Tunable defaults of the profile, feature, decision and monitoring layers."""

    lookback_months: int = 3
    half_life_days: float = 90.0
    top_n: int = 15
    min_pattern_obs: int = 2
    min_tenure_days: int = 90
    min_clean_txns: int = 100
    max_fraud_txns: int = 0
    trust_confidence: int = 60
    max_sane_amount: float = 1e13
    retrain_min_new: int = 100
    retrain_max_age_days: int = 30
    drift_amount_pct: float = 0.5
    drift_signals: int = 5
    ml_min_txns: int = 50
    ml_min_days: int = 30
    holdout_frac: float = 0.20
    seed: int = 42
    trees: int = 300
    tree_sample: int = 256
    embedding_dim: int = 32
    bottleneck: int = 16
    blend_mode: str = "escalate"
    detector_high: float = 0.85
    psi_threshold: float = 0.25
    min_precision: float = 0.02
    min_synthetic_auc: float = 0.75
    live_window_hours: int = 24
    live_min_sample: int = 200
    flag_rate_min: float = 0.02
    flag_rate_max: float = 0.30
    precision_window_days: int = 30
    min_labels: int = 20
    velocity_retain_hours: int = 48
    geo_retain_hours: int = 168
    default_currency: str = "NGN"
    weights: dict = field(default_factory=lambda: {"gnn": 0.30, "isoforest": 0.35, "autoencoder": 0.35})
    tier_percentiles: dict = field(default_factory=lambda: {"unsafe_high": 99.9, "unsafe": 99.0, "review": 95.0})
    synthetic_band: tuple = (0.75, 0.85)


DEFAULTS = Settings()

# Local spellings of currencies and the code each stands for.
CURRENCY_ALIASES = {
    "NAIRA": "NGN", "₦": "NGN",
    "POUND": "GBP", "POUNDS": "GBP", "£": "GBP", "STERLING": "GBP",
    "EURO": "EUR", "EUROS": "EUR", "€": "EUR",
    "DOLLAR": "USD", "DOLLARS": "USD", "$": "USD", "USDOLLAR": "USD",
    "KSH": "KES", "KSHS": "KES", "SHILLING": "KES",
    "CEDI": "GHS", "CEDIS": "GHS",
    "RAND": "ZAR",
}

# Accepted spellings of an analyst's verdict.
GENUINE_WORDS = ("genuine", "legit", "legitimate", "clean", "ok", "false_positive")
FRAUD_WORDS = ("fraud", "fraudulent", "bad", "confirmed_fraud", "true_positive")

# Velocity windows in minutes.
VELOCITY_MINUTES = {"vel_1m": 1, "vel_2m": 2, "vel_3m": 3, "vel_10m": 10, "vel_15m": 15, "vel_1h": 60, "vel_24h": 1440}

# The feature vector, in contract order.
FEATURES = (
    "amt_log", "amt_z", "amt_over_median", "amt_over_p95", "amt_over_max", "above_max",
    "hour_rarity", "dow_rarity", "is_night",
    "location_new", "country_new", "cross_border", "beneficiary_new", "type_rare", "ip_new",
    "vel_1m", "vel_2m", "vel_3m", "vel_10m", "vel_15m", "vel_1h", "vel_24h",
    "amt_1h_ratio", "recency_hours",
    "g_fanout", "g_distinct_benef", "g_shared_cp",
)

# Activity codes with status and meaning.
CODES = {
    "BF-100": ("safe", "Consistent with the customer's behaviour"),
    "BF-110": ("safe", "Recurring / known pattern for this customer"),
    "BF-200": ("review", "Mild anomaly :monitor immediately"),
    "BF-301": ("unsafe", "Amount anomaly vs the customer's history"),
    "BF-302": ("unsafe", "Unusual time for this customer"),
    "BF-303": ("unsafe", "Unusual location for this customer"),
    "BF-304": ("unsafe", "New / unusual beneficiary or counterparty structure"),
    "BF-305": ("unsafe", "Velocity / burst anomaly"),
    "BF-400": ("unsafe", "Strong multi-signal anomaly:high risk"),
}

# Status -> (zone, label, recommended queue).
ZONES = {
    "safe": ("clear_normal", "Clear Normal", "bypass manual review"),
    "review": ("review_grey", "Review / Grey Zone", "secondary manual review"),
    "unsafe": ("priority_1_unsafe", "Priority-1 Unsafe", "auto-block or priority analyst verification"),
}

# Score cuts in force until a model has calibrated its own.
DEFAULT_CUTS = {"unsafe_high": 0.995, "unsafe": 0.98, "review": 0.90}

# Feature groups behind each unsafe code, in order of precedence on ties.
SIGNAL_GROUPS = (
    ("BF-301", ("amt_z", "amt_over_max", "above_max", "amt_over_p95")),
    ("BF-302", ("hour_rarity", "dow_rarity", "is_night")),
    ("BF-303", ("location_new", "country_new", "cross_border", "ip_new")),
    ("BF-304", ("beneficiary_new", "g_shared_cp", "g_fanout", "g_distinct_benef")),
    ("BF-305", ("vel_1m", "vel_2m", "vel_3m", "vel_10m", "vel_15m", "vel_1h", "vel_24h", "amt_1h_ratio")),
)

# Detector names shown to analysts.
DETECTOR_LABELS = {
    "isoforest": "Isolation Forest", "autoencoder": "Autoencoder", "gnn": "Graph-structure model",
}

# Spike sizes of the synthetic anomalies per deviation axis.
SPIKES = {
    "amt_z": 6.0, "amt_over_median": 25.0, "amt_over_p95": 8.0, "amt_over_max": 4.0,
    "above_max": 1.0, "hour_rarity": 0.99, "dow_rarity": 0.9, "is_night": 1.0,
    "location_new": 1.0, "country_new": 1.0, "cross_border": 1.0, "beneficiary_new": 1.0,
    "type_rare": 1.0, "ip_new": 1.0, "vel_1h": 8.0, "vel_24h": 12.0, "amt_1h_ratio": 10.0,
    "g_fanout": 30.0, "g_distinct_benef": 25.0, "g_shared_cp": 15.0,
}

WEEKDAYS_SHORT = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
