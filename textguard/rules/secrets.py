"""Credential rules.  No published patterns exist for these; each row was worked
out from the examples a credential scanner must flag, hence origin='inferred'."""

from textguard.rules.base import Rule

PATTERNS = [
    ("SEC-01", r"\bAKIA[0-9A-Z]{16}\b", "AWS Access Key ID", "critical", "", "akia", "AKIA" + "Z7" * 8, "AKIA-short"),
    ("SEC-02", r"\bASIA[0-9A-Z]{16}\b", "AWS Temporary Access Key ID", "critical", "", "asia", "ASIA" + "Z7" * 8, "ASIA PACIFIC"),
    ("SEC-03", r"arn:aws:iam::\d{12}:[A-Za-z0-9+=,.@_/\-]+", "AWS IAM ARN", "medium", "", "arn:aws", "arn:aws:iam::111122223333:role/Demo", "arn:aws:iam only"),
    ("SEC-04", r"aws_secret_access_key\s*[=:]\s*['\"]?[A-Za-z0-9/+=]{40}", "AWS Secret Access Key", "critical", "i", "_ & aws_secret", "AWS_SECRET_ACCESS_KEY=" + "aB3/" * 10, "aws_secret_access_key=none"),
    ("SEC-05", r"\bAIza[0-9A-Za-z_\-]{35}", "GCP API Key", "critical", "", "aiza", "AIza" + "Sy7-_" * 7, "AIza only"),
    ("SEC-06", r"\b[a-z0-9\-]+@[a-z0-9\-]+\.iam\.gserviceaccount\.com\b", "GCP Service Account", "high", "", "@ & gserviceaccount", "bot@demo-app.iam.gserviceaccount.com", "gserviceaccount docs"),
    ("SEC-07", r"\"type\"\s*:\s*\"service_account\"", "GCP Service Account JSON", "critical", "", "_ & service_account", '{"type": "service_account"}', "a service_account"),
    ("SEC-08", r"\bAccountKey\s*=\s*[A-Za-z0-9+/]{86}==", "Azure Storage Account Key", "critical", "", "== & accountkey", "AccountKey=" + "aB" * 43 + "==", "AccountKey=aB"),
    ("SEC-09", r"\bghp_[A-Za-z0-9]{36}\b", "GitHub Personal Access Token", "critical", "", "_ & ghp_", "ghp_" + "a1B2" * 9, "ghp_short"),
    ("SEC-10", r"\bgho_[A-Za-z0-9]{36}\b", "GitHub OAuth Token", "critical", "", "_ & gho_", "gho_" + "a1B2" * 9, "gho_short"),
    ("SEC-11", r"\bxox[abprs]-[A-Za-z0-9\-]{10,}", "Slack Token", "critical", "", "xox", "xoxb-" + "1234567890-" + "abcdef", "xox only"),
    ("SEC-12", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", "Slack Webhook URL", "critical", "", ":// & hooks.slack", "https://hooks.slack.com/" + "services/T000/B000/XXXX", "https://hooks.slack.com/"),
    ("SEC-13", r"\b[sr]k_live_[A-Za-z0-9]{20,}", "Stripe Live Key", "critical", "", "_ & k_live_", "sk_live_" + "4eC3" * 6, "sk_live_x"),
    ("SEC-14", r"\b[sr]k_test_[A-Za-z0-9]{20,}", "Stripe Test Key", "high", "", "_ & k_test_", "sk_test_" + "4eC3" * 6, "sk_test_x"),
    ("SEC-15", r"-----BEGIN (?:RSA |EC |DSA |ENCRYPTED )?PRIVATE KEY-----", "Private Key", "critical", "", "--- & private key-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
    ("SEC-16", r"-----BEGIN OPENSSH PRIVATE KEY-----", "OpenSSH Private Key", "critical", "", "--- & private key-----", "-----BEGIN OPENSSH PRIVATE KEY-----", "BEGIN OPENSSH"),
    ("SEC-17", r"\bpostgres(?:ql)?://[^\s:/@]+:[^\s@]+@[^\s]+", "PostgreSQL Connection String with Credentials", "critical", "i", ":// & postgres", "postgresql://demo:pw12345@host:5432/app", "postgresql://host/app"),
    ("SEC-18", r"\bmongodb(?:\+srv)?://[^\s:/@]+:[^\s@]+@[^\s]+", "MongoDB Connection String with Credentials", "critical", "i", ":// & mongodb", "mongodb+srv://demo:pw12345@host/app", "mongodb://host/app"),
    ("SEC-19", r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{3,}", "JSON Web Token", "high", "", "eyj", "eyJ" + "abcd" * 4 + ".eyJ" + "efgh" * 4 + ".sig9", "eyJabc"),
    ("SEC-20", r"\b(?:password|passwd|pwd)\s*[=:]\s*['\"]?[^\s'\"]{8,}", "Password Assignment", "high", "i", "passw or pwd", "password = 'Tr0ub4dor&3x'", "password reset"),
    ("SEC-21", r"\b(?:api[_\-]?key|api[_\-]?token|access[_\-]?token|auth[_\-]?token|secret|token)\s*[=:]\s*['\"]?[A-Za-z0-9_\-.]{16,}", "API Key or Token Assignment", "high", "i", "api or token or secret", "api_key=demo_value_for_tests_12345", "api key missing"),
    ("SEC-22", r"\bsk-(?:proj-)?[A-Za-z0-9]{32,}", "OpenAI API Key", "critical", "", "sk-", "sk-" + "a1B2c3D4" * 5, "sk-short"),
    ("SEC-23", r"\bhf_[A-Za-z0-9]{30,}", "Hugging Face Token", "critical", "", "_ & hf_", "hf_" + "aBcD" * 8 + "12", "hf_short"),
    ("SEC-24", r"\br8_[A-Za-z0-9]{36,}", "Replicate API Token", "critical", "", "_ & r8_", "r8_" + "aBcD" * 9, "r8_short"),
    ("SEC-25", r"\bsk-or-v1-[A-Za-z0-9]{24,}", "OpenRouter API Key", "critical", "", "sk- & sk-or", "sk-or-v1-" + "ab12" * 8, "sk-or-v1-x"),
    ("SEC-26", r"\bpcsk_[A-Za-z0-9_]{30,}", "Pinecone API Key", "critical", "", "_ & pcsk_", "pcsk_" + "ABcd" * 9, "pcsk_x"),
    ("SEC-27", r"\bsupabase_service(?:_role)?_key\s*[=:]\s*['\"]?[A-Za-z0-9_\-.]{20,}", "Supabase Service Role Key", "critical", "i", "_ & supabase", "SUPABASE_SERVICE_ROLE_KEY=" + "ab.12" * 5, "SUPABASE_SERVICE_ROLE_KEY unset"),
    ("SEC-28", r"https://[a-z]{20}\.supabase\.co\b", "Supabase Project URL", "medium", "", ":// & supabase", "https://" + "abcde" * 4 + ".supabase.co", "https://abc.supabase.co"),
    ("SEC-29", r"\bvercel_[A-Za-z0-9]{24,}", "Vercel Token", "critical", "i", "_ & vercel_", "vercel_" + "ABcd12" * 4, "vercel_x"),
    ("SEC-30", r"\b(?:cf|cloudflare)_api_(?:token|key)\s*[=:]\s*['\"]?[A-Za-z0-9_\-]{30,}", "Cloudflare API Token", "critical", "i", "_ & cf_api or cloudflare", "CF_API_TOKEN=" + "ABcd12" * 6, "CF_API_TOKEN=x"),
    ("SEC-31", r"\blin_api_[A-Za-z0-9]{30,}", "Linear API Key", "critical", "", "_ & lin_api_", "lin_api_" + "ABcd12" * 6, "lin_api_x"),
    ("SEC-32", r"\bsecret_[A-Za-z0-9]{40,}", "Notion Integration Token", "critical", "", "_ & secret_", "secret_" + "ABcd12" * 7, "secret_x"),
    ("SEC-33", r"\bfigd_[A-Za-z0-9_\-]{30,}", "Figma Personal Access Token", "critical", "", "_ & figd_", "figd_" + "ABcd12" * 6, "figd_x"),
]


def rules() -> list[Rule]:
    return [
        Rule(rid, "secrets", regex, desc, severity, 0.95, "secrets", flags=flags,
             shape="hidden", needs=needs, hit=hit, miss=miss, origin="inferred")
        for rid, regex, desc, severity, flags, needs, hit, miss in PATTERNS
    ]
