"""Fixed values.

These lists are domain vocabularies (value domains of the bank tables, the
high-risk jurisdiction list, tenor buckets, role names).  They are kept here,
together and in natural order, so every operator and the test fixtures use the
same spelling.
"""

# --- fixed values: value domains -------------------------------------------
SEGMENTS = ["RETAIL", "SME", "CORPORATE", "PRIVATE_BANKING"]
KYC_STATUSES = ["VERIFIED", "PENDING", "EXPIRED", "REJECTED"]
RISK_RATINGS = ["LOW", "MEDIUM", "HIGH"]
ACCOUNT_TYPES = ["SAVINGS", "CURRENT", "LOAN", "CREDIT_CARD", "OVERDRAFT"]
ACCOUNT_STATUSES = ["ACTIVE", "DORMANT", "NPA", "FROZEN", "CLOSED"]
NPA_CLASSES = ["SUBSTANDARD", "DOUBTFUL", "LOSS"]
CURRENCIES = ["USD", "USD", "USD", "USD", "GBP", "EUR", "INR", "SGD"]
CHANNELS = ["UPI", "NEFT", "RTGS", "ATM", "POS", "WIRE", "INTERNAL"]
TXN_CATEGORIES = ["SALARY", "RENT", "TRANSFER", "PURCHASE", "CASH", "UTILITY", "INSURANCE", "OTHER"]
SAFE_COUNTRIES = ["USA", "GBR", "SGP"]
# FATF grey/black-list jurisdictions used by the cross-border rule.
HIGH_RISK_COUNTRIES = ["IRN", "PRK", "SYR", "MMR", "YEM", "LBY", "SDN", "BLR", "RUS", "VEN"]
FACILITY_TYPES = ["TERM_LOAN", "REVOLVING", "MORTGAGE", "LETTER_OF_CREDIT", "GUARANTEE", "WORKING_CAPITAL"]
INTERNAL_RATINGS = ["AAA", "AA", "A", "BBB", "BB", "B", "CCC", "D"]
COLLATERAL_TYPES = ["PROPERTY", "EQUITY", "FIXED_DEPOSIT", "VEHICLE", "MACHINERY", "UNSECURED"]
SECTORS = ["REAL_ESTATE", "MANUFACTURING", "TRADE", "SERVICES", "AGRICULTURE", "TECHNOLOGY", "HEALTHCARE", "ENERGY"]
RISK_WEIGHTS = [100, 75, 150, 50, 20]
TENOR_BUCKETS = ["0_7D", "8_30D", "31_90D", "91_365D", "OVER_1YR"]
FILING_TYPES = ["SAR", "CTR", "STR", "SUSPICIOUS_ACTIVITY"]
FILING_STATUSES = ["DRAFT", "SUBMITTED", "ACKNOWLEDGED", "CLOSED", "REJECTED"]
REGULATORY_BODIES = ["FinCEN", "RBI", "FCA", "MAS", "AUSTRAC"]
FILING_OUTCOMES = ["FILED", "DECLINED", "ESCALATED", "UNDER_INVESTIGATION"]
CASE_TYPES = ["FRAUD", "AML", "CREDIT", "LIQUIDITY", "SANCTIONS"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CASE_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CASE_STATUSES = ["OPEN", "UNDER_REVIEW", "ESCALATED", "RESOLVED", "CLOSED"]
DOC_TYPES = ["REGULATION", "INTERNAL_POLICY", "SAR_NARRATIVE", "AUDIT_FINDING", "FAQ"]
FRAUD_PATTERNS = ["VELOCITY", "STRUCTURING", "CROSS_BORDER", "ROUND_NUMBER"]
FLAG_DOMAINS = ["FRAUD", "CREDIT", "LIQUIDITY"]

# --- fixed values: roles ----------------------------------------------------
ROLE_ADMIN = "ADMIN"
ROLE_COMPLIANCE = "COMPLIANCE_OFFICER"
ROLE_MANAGER = "RISK_MANAGER"
ROLE_ANALYST = "RISK_ANALYST"
ROLE_AUDITOR = "AUDITOR"
ROLE_PLATFORM = "PLATFORM_ADMIN"
ALL_ROLES = [ROLE_ADMIN, ROLE_COMPLIANCE, ROLE_MANAGER, ROLE_ANALYST, ROLE_AUDITOR, ROLE_PLATFORM]
# role -> parent role it is granted to (child privileges flow up to the parent)
ROLE_EDGES = [
    (ROLE_ANALYST, ROLE_MANAGER),
    (ROLE_MANAGER, ROLE_COMPLIANCE),
    (ROLE_COMPLIANCE, ROLE_ADMIN),
    (ROLE_AUDITOR, ROLE_ADMIN),
    (ROLE_ADMIN, ROLE_PLATFORM),
]
BANK_DOMAIN = "@bank.example"

# --- fixed values: thresholds (documented rule parameters) ------------------
VELOCITY_MIN_TXNS = 5
VELOCITY_WINDOW = "1 hour"
STRUCTURING_LO = 9800
STRUCTURING_HI = 9999
ROUND_NUMBER_MIN = 10000
ROUND_NUMBER_STEP = 1000
FRAUD_SCORE_LIMIT = 65
WATCH_LIST_PD = 0.15
HIGH_PD = 0.20
SEVERE_PD = 0.35
UTILISATION_LIMIT = 90
# score ranges per fraud pattern: (low, high); unflagged rows get NONE
SCORE_RANGES = {
    "VELOCITY": (65, 95),
    "STRUCTURING": (60, 85),
    "CROSS_BORDER": (70, 95),
    "ROUND_NUMBER": (55, 75),
    "NONE": (5, 40),
}
FRAUD_SEVERITY = {
    "VELOCITY": "HIGH",
    "STRUCTURING": "HIGH",
    "CROSS_BORDER": "CRITICAL",
    "ROUND_NUMBER": "MEDIUM",
}
REVIEWER = "compliance.officer" + BANK_DOMAIN

# fixed values: texts that callers of the actions get back or store
ERR_SAR_ROLE = "COMPLIANCE_OFFICER or higher required."
ERR_CASE_ROLE = "RISK_MANAGER or higher required."
ERR_DUPLICATE = "Duplicate request in batch"
ERR_FLAG = "Flag not found or already actioned"
ERR_NO_CUSTOMER = "no_customer"
ERR_ACCOUNT = "Account not found"
ERR_CASE = "Case not found or already resolved/closed"
MSG_SAR = "SAR draft created."
MSG_FREEZE = "Account flagged and case opened."
MSG_ESCALATE = "Case escalated."

# fixed values: countries of the generated transactions
GENERATED_COUNTRIES = ["USA", "GBR", "CAN", "AUS", "DEU", "FRA", "SGP", "JPN", "NLD", "CHE"]
