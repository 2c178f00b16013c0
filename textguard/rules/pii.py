"""Personal-data rules: Indian and international identifiers, all matches reported."""

from textguard.rules.base import Rule

# Names, labels, severities, patterns, flags, validators.
PATTERNS = [
    ("PII-01", "Aadhaar", "AADHAAR", "critical", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", "", "aadhaar",
     r"re:\p{Nd}{4}", "id 2345 6789 0123 given", "id 1345 6789 0123 given"),
    ("PII-02", "PAN", "PAN", "critical", r"\b[A-Z]{5}\d{4}[A-Z]\b", "", "",
     r"re:\p{Nd}{4}", "pan ABCDE1234F noted", "pan abcde1234f noted"),
    ("PII-03", "Indian Passport", "PASSPORT", "high", r"\b[A-PR-WYa-pr-wy]\d{7}\b", "", "",
     r"re:\p{Nd}{4}", "passport K1234567 seen", "passport Q1234567 seen"),
    ("PII-04", "IFSC Code", "IFSC", "high", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "", "",
     r"re:\p{Nd} & re:[a-z]{4}0", "branch HDFC0001234 open", "branch HDFC1001234 open"),
    ("PII-05", "UPI VPA", "UPI_VPA", "high", r"\b[\w.\-]{3,}@(okaxis|oksbi|okicici|okhdfcbank|paytm|ybl|upi|axl|ibl|icici|sbi|hdfc)\b", "i", "",
     "@", "pay asha.rao@okaxis today", "pay asha@okbank today"),
    ("PII-06", "Indian Voter ID", "VOTER_ID", "high", r"\b[A-Z]{3}\d{7}\b", "", "",
     r"re:\p{Nd}{4}", "voter XYZ1234567 listed", "voter XY1234567 listed"),
    ("PII-07", "ABHA Health ID", "ABHA_HEALTH_ID", "critical", r"\b\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "", "abha",
     r"re:\p{Nd}{4}", "health 12-3456-7890-1234 issued", "health 123-4567-8901 issued"),
    ("PII-08", "UAN (EPFO)", "UAN_EPFO", "critical", r"(?:UAN|EPFO|provident\s+fund\s+(?:no\.?|number|#)|PF\s+(?:no\.?|number))\s*[:\-]?\s*(\d{12})", "i", "",
     r"re:\p{Nd}{4}", "PF number: 100200300400 active", "PF number pending"),
    ("PII-09", "Indian Driving Licence", "DRIVING_LICENCE", "high", r"\b[A-Z]{2}[-\s]?\d{2}[-\s]?\d{4}[-\s]?\d{7}\b", "", "",
     r"re:\p{Nd}{4}", "licence MH-01-2015-1234567 valid", "licence M-01-2015-1234567 valid"),
    ("PII-10", "Indian Phone", "PHONE_IN", "high", r"(?:\+91[\s-]?)?[6-9]\d{9}\b", "", "",
     r"re:\p{Nd}{4}", "ring +91 9876543210 now", "ring 5876543210 now"),
    ("PII-11", "Email", "EMAIL", "medium", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "", "",
     "@", "write to ann.lee@mail.example.org soon", "write to ann at example"),
    ("PII-12", "Credit Card", "CREDIT_CARD", "critical", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011)[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "", "luhn",
     r"re:\p{Nd}{4}", "card 4532 0151 1283 0366 used", "card 4532 0151 1283 0367 used"),
    ("PII-13", "SSN", "SSN", "critical", r"\b(?!000|666|9\d{2})\d{3}[\s\-](?!00)\d{2}[\s\-](?!0000)\d{4}\b", "", "",
     r"re:\p{Nd}{4}", "ssn 123-45-6789 filed", "ssn 666-45-6789 filed"),
    ("PII-14", "IBAN", "IBAN", "high", r"\b[A-Z]{2}\d{2}[\s]?[A-Z0-9]{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{0,12}\b", "", "",
     r"re:\p{Nd}{4}", "iban GB29 NWBK 6016 1331 926819 sent", "iban G29 NWBK 6016 1331 sent"),
    ("PII-15", "IPv4", "IP_ADDRESS", "low", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "", "public_ip",
     r"re:\p{Nd}\.\p{Nd}", "host 8.8.4.4 replied", "host 192.168.1.9 replied"),
    ("PII-16", "International Phone", "PHONE", "medium", r"\+(?:[1-9]\d{0,2})[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{1,4}[\s.\-]?\d{1,9}\b", "", "",
     "+", "dial +1 415 555 0134 please", "dial 415-555 please"),
]

# Fixed value: addresses that are not reported.
PRIVATE_IP = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|::1|localhost)"


def rules() -> list[Rule]:
    return [
        Rule(rid, "pii", regex, name, severity, 0.90, "pii_input", flags=flags, label=label,
             shape="length", needs=needs, hit=hit, miss=miss, validator=validator)
        for rid, name, label, severity, regex, flags, validator, needs, hit, miss in PATTERNS
    ]
