"""Financial-disclosure rules."""

from textguard.rules.base import Rule

# Shared fragments, then patterns, descriptions, severities, labels.
RUPEES = r"(?:₹|INR|Rs\.?)\s*"
DOLLARS = r"(?:\$|USD)\s*"
AMOUNT = r"\d{1,3}(?:,\d{2,3})*(?:\.\d+)?\s*(?:Cr|L|K|M|B|Mn|Bn|lakh|crore|million|billion|thousand)?"
MONEY = "(?:" + RUPEES + "|" + DOLLARS + ")" + AMOUNT
MAYBE_MONEY = "(?:" + RUPEES + "|" + DOLLARS + ")?" + AMOUNT

PATTERNS = [
    ("FIN-01", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}Z[A-Z\d]\b", "GST Identification Number (GSTIN)", "critical", "GSTIN",
     r"re:\p{Nd}{4}", "gst 27ABCDE1234F1Z5 paid", "gst 27ABCD1234F1Z5 paid"),
    ("FIN-02", r"\bU\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b", "Company Identification Number (CIN)", "high", "CIN",
     r"re:\p{Nd}{4}", "cin U12345MH2010PTC123456 listed", "cin U1234MH2010PTC123456 listed"),
    ("FIN-03", r"\b[A-Z]{4}[0-9]{7}\b", "Indian MICR Code", "medium", "MICR",
     r"re:\p{Nd}{4}", "micr ABCD1234567 printed", "micr ABC1234567 printed"),
    ("FIN-04", r"\b(?:SWIFT|BIC|bank\s+code|routing)\s*[:#]?\s*[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "SWIFT/BIC Code", "high", "SWIFT_BIC",
     "swift or bic or bank or routing", "swift: DEUTDEFF500 ok", "swift: 12 ok"),
    ("FIN-05", r"(?:account\s*(?:number|no\.?|#)\s*:?\s*)(\d{9,18})\b", "Bank account number", "critical", "BANK_ACCOUNT",
     r"re:\p{Nd}{4} & account", "account number: 123456789012 closed", "account number: 1234 closed"),
    ("FIN-06", r"(?:acc\.?\s*no\.?\s*:?\s*)(\d{9,18})\b", "Bank account number", "critical", "BANK_ACCOUNT",
     r"re:\p{Nd}{4} & acc", "acc. no. 987654321012 closed", "acc. no. 98 closed"),
    ("FIN-07", r"(?:CTC|ctc|salary|compensation|package)\s*(?:of|is|:)?\s*" + RUPEES + AMOUNT, "Salary/CTC disclosure", "high", "SALARY_CTC",
     r"re:\p{Nd} & ctc or salary or compensation or package & ₹ or inr or rs", "salary of ₹24,00,000 agreed", "salary of 2400 agreed"),
    ("FIN-08", r"(?:fixed|variable|bonus|hike|increment|appraisal)\s*(?:of|:)?\s*" + RUPEES + AMOUNT, "Compensation component disclosure", "high", "COMPENSATION",
     r"re:\p{Nd} & fixed or variable or bonus or hike or increment or appraisal & ₹ or inr or rs", "bonus of Rs. 50,000 paid", "bonus of 50 points"),
    ("FIN-09", r"(?:offer(?:ed)?|joining)\s+(?:bonus|amount)\s*(?:of|:)?\s*" + RUPEES + AMOUNT, "Joining bonus disclosure", "high", "JOINING_BONUS",
     r"re:\p{Nd} & offer or joining & ₹ or inr or rs", "joining amount: INR 2 lakh set", "joining amount pending"),
    ("FIN-10", r"\bESOPs?\s*(?:of|worth|valued|:)?\s*" + RUPEES + AMOUNT, "ESOP value disclosure", "high", "ESOP_VALUE",
     r"re:\p{Nd} & esop & ₹ or inr or rs", "ESOPs worth ₹10 lakh given", "ESOPs worth little"),
    ("FIN-11", r"\b(?:ARR|MRR|revenue|turnover|GMV|GTV|NRR|GRR)\s*(?:of|is|was|:)?\s*" + MONEY, "Revenue/ARR/MRR disclosure", "critical", "REVENUE_ARR",
     r"re:\p{Nd} & $ or usd or ₹ or inr or rs & arr or mrr or revenue or turnover or gmv or gtv or nrr or grr", "ARR is $2.4M today", "ARR is growing"),
    ("FIN-12", r"\b(?:Q[1-4]|FY\s*\d{2,4}|FQ[1-4])\s+(?:revenue|ARR|sales|bookings)\s*(?:of|is|was|:)?\s*" + MAYBE_MONEY, "Quarterly financial disclosure", "critical", "QUARTERLY_FINANCIALS",
     r"re:\p{Nd} & revenue or arr or sales or bookings & q or fy", "Q3 bookings of 14 million closed", "Q3 bookings rose"),
    ("FIN-13", r"(?:deal|contract|ACV|TCV|invoice)\s*(?:value|worth|size|amount)?\s*(?:of|is|:)?\s*" + MONEY, "Deal/contract value", "high", "DEAL_VALUE",
     r"re:\p{Nd} & deal or contract or acv or tcv or invoice & $ or usd or ₹ or inr or rs", "contract value of $5M set", "contract value rose"),
    ("FIN-14", r"(?:closed|won|signed)\s+(?:a\s+)?(?:deal|contract|customer)\s+(?:for|at|worth)\s*" + MONEY, "Deal closure amount", "high", "DEAL_CLOSED",
     r"re:\p{Nd} & deal or contract or customer & closed or won or signed & $ or usd or ₹ or inr or rs", "won a customer worth USD 300K", "won a customer"),
    ("FIN-15", r"(?:Series\s*[A-F]|Seed|Pre-seed|Bridge|IPO|round)\s+(?:of|at|raising|raised)?\s*" + MONEY, "Fundraising round amount", "critical", "FUNDRAISING",
     r"re:\p{Nd} & $ or usd or ₹ or inr or rs & series or seed or bridge or ipo or round", "Series B of ₹120Cr raised", "Series B raised"),
    ("FIN-16", r"(?:valuation|valued)\s+(?:at|of)?\s*" + MONEY, "Company valuation", "critical", "VALUATION",
     r"re:\p{Nd} & valu & $ or usd or ₹ or inr or rs", "valued at $50M post-money", "valued at little"),
    ("FIN-17", r"(?:term\s*sheet|LOI|letter\s*of\s*intent)", "Term sheet / LOI mention", "high", "TERM_SHEET",
     "sheet or loi or intent", "the term sheet is ready", "the term paper is ready"),
    ("FIN-18", r"(?:EBITDA|PAT|PBT|gross\s*profit|net\s*profit|operating\s*profit)\s*(?:of|is|:)?\s*" + MAYBE_MONEY, "P&L data", "critical", "PNL_DATA",
     r"re:\p{Nd} & ebitda or pat or pbt or profit", "EBITDA of 12 million booked", "EBITDA fell"),
    ("FIN-19", r"(?:burn\s*rate|runway|cash\s*balance|cash\s*in\s*bank)\s*(?:of|is|:)?\s*" + MAYBE_MONEY, "Cash/burn rate disclosure", "critical", "BURN_RATE",
     r"re:\p{Nd} & burn or runway or cash", "cash balance is $900K now", "runway lights"),
    ("FIN-20", r"(?:budget|approved|allocated)\s+(?:for|of)?\s*" + MONEY, "Budget data", "high", "BUDGET",
     r"re:\p{Nd} & budget or approved or allocated & $ or usd or ₹ or inr or rs", "budget of $40K granted", "budget of time"),
    ("FIN-21", r"\b(?:acquisition|acquiring|merger|acqui-?hire|takeover)\s+(?:of|target|talks|discussion)", "M&A activity mention", "critical", "MA_ACTIVITY",
     "acqui or merger or takeover", "merger talks began", "a merger was denied"),
    ("FIN-22", r"(?:due\s*diligence|data\s*room|VDR)\s+(?:for|on|of)", "Due diligence mention", "high", "DUE_DILIGENCE",
     "diligence or room or vdr", "due diligence on the firm", "due diligence matters"),
]


def rules() -> list[Rule]:
    return [
        Rule(rid, "financial", regex, desc, severity, 0.88, "pii_input", flags="im",
             label=label, shape="wrap60", needs=needs, hit=hit, miss=miss)
        for rid, regex, desc, severity, label, needs, hit, miss in PATTERNS
    ]
