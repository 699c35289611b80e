"""The small lookup tables every rule in this package is built from.

Everything here is a plain constant held on the driver, so its size is known and
it reaches the executors inside the expressions that use it.
"""

from __future__ import annotations

# Sender domain -> bank name, checked in this order.
BANK_DOMAINS: dict[str, str] = {
    "hdfcbank.net": "HDFC",
    "hdfcbank.com": "HDFC",
    "hdfcbankmail.com": "HDFC",
    "icicibank.com": "ICICI",
    "icicibank.co.in": "ICICI",
    "iciciprulife.com": "ICICI",
    "axisbank.com": "Axis",
    "axisdirect.in": "Axis",
    "kotak.com": "Kotak",
    "kotakbank.com": "Kotak",
    "sbi.co.in": "SBI",
    "onlinesbi.com": "SBI",
    "sbicard.com": "SBI",
    "pnb.co.in": "PNB",
    "bankofbaroda.co.in": "BOB",
    "bobfinancial.com": "BOB",
    "bajajfinserv.in": "Bajaj Finserv",
    "bajajfinance.in": "Bajaj Finserv",
    "aexp.com": "AMEX",
    "americanexpress.com": "AMEX",
    "americanexpress.co.in": "AMEX",
    "cred.club": "CRED",
    "indusind.com": "IndusInd",
    "yesbank.in": "Yes Bank",
    "idfcfirstbank.com": "IDFC First",
    "rbl.bank": "RBL",
    "aubank.in": "AU Bank",
    "federalbank.co.in": "Federal",
}

# Folders read per mail provider; any other provider reads INBOX.
PROVIDER_FOLDERS: dict[str, list[str]] = {
    "Gmail": ["INBOX", "[Gmail]/Promotions", "[Gmail]/Updates"],
    "Outlook": ["INBOX", "Promotions", "Updates"],
    "Yahoo": ["INBOX", "Bulk Mail"],
}
DEFAULT_FOLDERS = ["INBOX"]

# Label -> keywords, in the order that settles ties.
LABEL_KEYWORDS: dict[str, list[str]] = {
    "FUNDS_CREDITED_ALERT": ["credited", "received", "added", "refund"],
    "FUNDS_DEBITED_ALERT": ["debited", "spent", "paid", "withdrawn"],
    "OTP_SECURITY_ALERT": ["otp", "login", "password", "security"],
    "CREDIT_LOAN_PROMOTION": [
        "loan", "pre-approved", "pre approved", "cashback", "offer",
        "discount", "upgrade", "reward", "points", "membership",
    ],
    "REGULATORY_KYC_NOTICE": ["kyc", "rbi", "pan", "aadhaar"],
    "ACCOUNT_STATEMENT_BILL": ["statement", "due", "bill", "amb"],
    "CREDIT_SCORE_BUREAU_ALERT": ["cibil", "experian", "score", "inquiry"],
    "CREDIT_LIMIT_CARD_MANAGEMENT": ["limit", "upgrade", "blocked", "activation"],
}
OTHER_LABEL = "OTHER"
CREDIT_LABEL = "FUNDS_CREDITED_ALERT"
DEBIT_LABEL = "FUNDS_DEBITED_ALERT"
PROMOTION_LABEL = "CREDIT_LOAN_PROMOTION"

# Words that give a money movement its direction, debit first.
DEBIT_WORDS = ["debited", "spent", "purchase", "withdrawn", "paid"]
CREDIT_WORDS = ["credited", "received", "refund", "cashback"]

# Payment mode -> word in the text, first hit wins.
PAYMENT_MODES: dict[str, str] = {
    "UPI": "upi",
    "NEFT": "neft",
    "IMPS": "imps",
    "RTGS": "rtgs",
    "Card": "card",
    "EMI": "emi",
}

# Spending category -> keywords, first category with a hit wins.
SPENDING_KEYWORDS: dict[str, list[str]] = {
    "Food & Dining": ["swiggy", "zomato", "restaurant", "food", "cafe", "dining", "pizza", "burger"],
    "Shopping": ["amazon", "flipkart", "myntra", "ajio", "shopping", "store", "mall", "mart"],
    "Travel": ["uber", "ola", "makemytrip", "irctc", "flight", "hotel", "travel", "cab", "train"],
    "Entertainment": ["netflix", "hotstar", "spotify", "movie", "theatre", "gaming"],
    "Utilities": ["electricity", "water", "gas", "broadband", "jio", "airtel", "recharge", "bill"],
    "Fuel": ["petrol", "diesel", "fuel", "hp", "indian oil", "bharat petroleum"],
    "Health": ["pharmacy", "hospital", "doctor", "medical", "health", "apollo", "practo"],
    "Education": ["school", "college", "course", "udemy", "education", "tuition"],
    "Insurance": ["insurance", "premium", "lic", "policy"],
    "Investment": ["mutual fund", "sip", "stock", "zerodha", "groww", "investment"],
    "EMI": ["emi", "loan", "installment"],
    "Grocery": ["grocery", "bigbasket", "blinkit", "zepto", "dmart", "supermarket"],
    "Transfer": ["transfer", "upi", "neft", "imps", "rtgs", "sent to"],
}

# Offer category -> keywords, first category with a hit wins.
OFFER_KEYWORDS: dict[str, list[str]] = {
    "Cashback": ["cashback", "cash back"],
    "Discount": ["discount", "% off", "flat off"],
    "Rewards": ["reward", "points", "bonus"],
    "Travel": ["travel", "flight", "hotel", "booking"],
    "Shopping": ["shopping", "amazon", "flipkart"],
    "Dining": ["dining", "food", "restaurant"],
    "Fuel": ["fuel", "petrol"],
    "EMI": ["emi", "no cost"],
}

# Tag shown in front of a mail with this label.
LABEL_ICONS: dict[str, str] = {
    "FUNDS_CREDITED_ALERT": "[CREDIT]",
    "FUNDS_DEBITED_ALERT": "[DEBIT]",
    "OTP_SECURITY_ALERT": "[SECURITY]",
    "CREDIT_LOAN_PROMOTION": "[PROMO]",
    "REGULATORY_KYC_NOTICE": "[KYC]",
    "ACCOUNT_STATEMENT_BILL": "[BILL]",
    "CREDIT_SCORE_BUREAU_ALERT": "[BUREAU]",
    "CREDIT_LIMIT_CARD_MANAGEMENT": "[CARD]",
}
DEFAULT_ICON = "[EMAIL]"

# Period presets of the day chart as (unit, count).
PERIODS: dict[str, tuple[str, int]] = {
    "1W": ("day", 7),
    "1M": ("month", 1),
    "6M": ("month", 6),
    "YTD": ("year_to_date", 1),
    "1Y": ("month", 12),
    "All": ("all", 0),
}

# Limits and texts.
INITIAL_SYNC_DAYS = 3
MIN_BODY_CHARS = 50
MAX_BODY_CHARS = 10_000
MAX_RAW_CHARS = 500
MAX_OFFER_CHARS = 1_000
MIN_OFFER_CHARS = 20
MAX_LINKS = 3
MAX_LINK_CHARS = 150
MAX_IMAGES = 5
MIN_OCR_CHARS = 10
MAX_OCR_CHARS = 500
IMAGE_MIN_BYTES = 1_000
IMAGE_MAX_BYTES = 10_000_000
IMAGE_MIN_SIDE = 50
OCR_MARKER = "[VISION EXTRACTED]"
NO_SUBJECT = "(No Subject)"
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
