"""Parameters and fixed values.

Values marked FIXED VALUES must equal the original application's for results to
agree; they are stated plainly, in their natural order.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — impulse guard
# ---------------------------------------------------------------------------
NIGHT_START = "00:00"
NIGHT_END = "06:00"
IMPULSE_AMOUNT_THRESHOLD = 100.0
IMPULSE_RISK_SCORE_THRESHOLD = 70
DELAY_MINUTES_HIGH_RISK = 5
HIGH_RISK_CATEGORIES = ["jogos", "delivery", "lazer", "compras", "assinaturas"]
HOUR_RISK_MULTIPLIERS = {0: 1.5, 1: 1.8, 2: 2.0, 3: 2.0, 4: 1.8, 5: 1.5, 6: 1.0}

# ---------------------------------------------------------------------------
# FIXED VALUES — categories and transaction types
# ---------------------------------------------------------------------------
CATEGORIES = [
    "alimentação", "transporte", "moradia", "saúde", "lazer", "educação",
    "delivery", "jogos", "assinaturas", "compras", "transferência",
    "salário", "investimentos", "outros",
]
TRANSACTION_TYPES = ["credito", "debito"]

# ---------------------------------------------------------------------------
# FIXED VALUES — anomaly detection
# ---------------------------------------------------------------------------
ANOMALY_CONTAMINATION = 0.1
ANOMALY_N_ESTIMATORS = 100
ANOMALY_RANDOM_STATE = 42
ANOMALY_MIN_FIT_ROWS = 10
HEURISTIC_RISK_CATEGORIES = ["jogos", "apostas", "cassino", "bet"]
REASON_RISK_CATEGORIES = ["jogos", "apostas", "cassino"]

# ---------------------------------------------------------------------------
# FIXED VALUES — spending analysis
# ---------------------------------------------------------------------------
WEEKDAY_LABELS = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]
PERIOD_LABELS = ["Madrugada", "Manhã", "Tarde", "Noite"]
SOCIAL_CATEGORIES = ["lazer", "delivery", "restaurante", "bar"]
REDUCIBLE_CATEGORIES = ["delivery", "lazer", "assinaturas", "jogos", "compras"]
PROFILE_ORDER = ["notívago", "impulsivo", "social", "sazonal", "controlado"]
CATEGORY_ACTIONS = {
    "delivery": "Cozinhe mais em casa. Prepare marmitas no fim de semana.",
    "lazer": "Busque alternativas gratuitas: parques, eventos públicos.",
    "assinaturas": "Revise todas as assinaturas. Cancele as não utilizadas.",
    "jogos": "Defina um orçamento mensal fixo para jogos.",
    "compras": "Use a regra das 48h antes de comprar algo não essencial.",
    "transporte": "Considere carona, transporte público ou bicicleta.",
    "alimentação": "Faça lista de compras e evite ir ao mercado com fome.",
}
DEFAULT_CATEGORY_ACTION = "Analise se este gasto é realmente necessário."
KMEANS_CLUSTERS = 4
KMEANS_STARTS = 10
KMEANS_SEED = 42

# ---------------------------------------------------------------------------
# FIXED VALUES — text model
# ---------------------------------------------------------------------------
NB_MAX_FEATURES = 1000
NB_MIN_DF = 2
NB_ALPHA = 0.1
RULES_HIGH_CONFIDENCE = 0.7

# ---------------------------------------------------------------------------
# FIXED VALUES — files and retention
# ---------------------------------------------------------------------------
MAX_UPLOAD_SIZE_MB = 10
ALLOWED_EXTENSIONS = ["png", "jpg", "jpeg", "pdf", "ofx", "csv"]
NOTIFICATION_RETENTION = 1000
DEFAULT_READ_LIMIT = 100


@dataclass(frozen=True)
class GuardParams:
    """Settings of the impulse guard (one per deployment, not per row)."""

    night_start: str = NIGHT_START
    night_end: str = NIGHT_END
    amount_threshold: float = IMPULSE_AMOUNT_THRESHOLD
    high_risk_threshold: int = IMPULSE_RISK_SCORE_THRESHOLD
    delay_minutes: int = DELAY_MINUTES_HIGH_RISK
    high_risk_categories: tuple = field(default_factory=lambda: tuple(HIGH_RISK_CATEGORIES))

    def threshold(self) -> float:
        # A zero threshold falls back to the default, as in the original.
        return self.amount_threshold or IMPULSE_AMOUNT_THRESHOLD


DEFAULT_GUARD = GuardParams()
