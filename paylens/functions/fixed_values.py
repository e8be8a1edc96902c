"""Fixed values of the data contract.

Everything here must match the upstream systems literally; nothing is derived.
"""

from __future__ import annotations

import datetime as dt

# --- scope of an analysed payment attempt -------------------------------
SOURCE_SYSTEMS = (115, 134, 139)
TRANS_TYPES = ("purchase", "verify")
SUCCESS_STATUSES = ("success", "void")
DECLINED_STATUS = "declined"
TRANS_STATUSES = ("success", "void", "declined")
API_ORIGINS = ("api", "token_api")
CARD_METHOD = "Credit Card"
AVS_PASSED = ("Y", "X", "V")

# --- sentinel timestamps (UTC) ------------------------------------------
NO_PRIOR_TS = "1900-01-01 00:00:01"
OPEN_ENDED_TS = "2999-12-31 23:59:59"
OPEN_ENDED_DATE = "2999-12-31"

# --- business dates ------------------------------------------------------
# dunning shortened from 28 to 27 days, and direct-to-paid no longer starts
# as a trial, from this day on
POLICY_CHANGE_DATE = dt.date(2025, 11, 6)
LEGACY_DUNNING_DAYS = 28
DUNNING_DAYS = 27

# --- event days left out of volume baselines -----------------------------
EVENT_DAY = (dt.date(2026, 1, 24),)
EVENT_WEEKEND = (dt.date(2026, 1, 24), dt.date(2026, 1, 25))
EVENT_WEEKENDS = EVENT_WEEKEND + (dt.date(2026, 1, 31), dt.date(2026, 2, 1))
EVENT_WEEKENDS_AND_MONTH_END = EVENT_WEEKENDS + (dt.date(2026, 2, 28),)

# --- time zones ----------------------------------------------------------
REPORT_ZONE = "America/Los_Angeles"
BILLING_ZONE = "America/New_York"

# --- gateway code -> market ---------------------------------------------
GATEWAYS_BY_MARKET = {
    "US": ("cljvv4pluxdo", "i3z3apzipbp7", "wf3nj05ig027", "o8kozk9x9qb0"),
    "AU": ("p3oy7jtrnbzu", "jt7jdrftfjyv"),
    "LATAM": ("ob5kihh2l5ht", "ob5lkextdfrs"),
    "UK": ("qpdcpwym9258", "qwazckp2zkjj", "t0gcwmn4afqk"),
    "BR": ("obkq1bdafejc",),
    "CA": ("inkqcylsbc8b",),
    "GSA_DE_AT_CH": (
        "sj7av2xpiqik",
        "rnuns7r579dp",
        "rnuoyv9lls4l",
        "rnum8iuze17e",
        "rnunet43fjj0",
        "rnuplcrtgiuv",
        "rnupcldy1szk",
    ),
    "MX": ("pnpypk0ag0nv",),
    "FR": ("rs7oav8d5e0f",),
    "IE": ("qpdel7kior3j", "qwazjh3p96l7"),
    "IT": ("reyg6kvzzovm", "ra6ffzgs9s8q", "t0h4mkezczbd"),
}

# --- source system -> alert geography -------------------------------------
GEO_BY_SOURCE = {115: "US", 134: "INTL"}
GEO_OTHER = "Legacy AU"

# --- collection vendor ----------------------------------------------------
VENDOR_APPROVAL_TEXT = "Collected by Vindicia"
VENDOR_ORIGIN = "vindicia"
BILLING_ORIGIN = "recurly"
