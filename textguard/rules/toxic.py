"""Harmful-request rules.  The zero-tolerance rules come first and end the scan."""

from textguard.rules.base import Rule

# Patterns, descriptions, severities and confidences.
ZERO_TOLERANCE_TEXT = "CSAM indicator — zero tolerance block"
ZERO_TOLERANCE = [
    ("TOX-Z01", r"\bCSAM\b", "csam", "report CSAM to the police", "a csams file"),
    ("TOX-Z02", r"child\s+(sexual|pornograph|nude|naked|exploit)", "child & sexual or pornograph or nude or naked or exploit", "child exploitation report", "child care"),
    ("TOX-Z03", r"(underage|minor|child|kid|toddler|infant)\s+(sex|porn|nude|naked|explicit)",
     "sex or porn or nude or naked or explicit & underage or minor or child or kid or toddler or infant", "laws against minor explicit media", "minor repairs"),
    ("TOX-Z04", r"(sexual|explicit)\s+(content|material|image)\s+(of|involving|with)\s+(minor|child|underage)",
     "sex or explicit & minor or child or underage", "a ban on explicit material involving minors", "explicit content warning"),
]

CRITICAL = [
    ("TOX-C01", r"(how\s+to\s+)?(make|create|build|synthesize|manufacture)\s+(a\s+)?(biological|chemical|nuclear|radiological)\s+(weapon|bomb|agent)", "WMD instruction request",
     "weapon or bomb or agent & biological or chemical or nuclear or radiological", "build a nuclear weapon", "build a nuclear family"),
    ("TOX-C02", r"(how\s+to\s+)?(make|create|build|synthesize)\s+(sarin|VX\s+nerve|mustard\s+gas|ricin|anthrax)", "Chemical/biological weapon request",
     "sarin or nerve or mustard or ricin or anthrax", "make mustard gas", "make mustard sauce"),
    ("TOX-C03", r"(how\s+to\s+)?(enrich|weaponize)\s+(uranium|plutonium)", "Nuclear material request", "nium & uranium or plutonium", "enrich uranium", "uranium is a metal"),
    ("TOX-C04", r"(how\s+to\s+)?(make|build|construct|assemble)\s+(a\s+)?(bomb|IED|explosive\s+device|pipe\s+bomb)", "Explosive device instructions",
     "bomb or ied or explosive & make or build or construct or assemble", "assemble a pipe bomb", "a bombastic make"),
    ("TOX-C05", r"TATP|PETN|RDX|C-4\s+explosive|ammonium\s+nitrate\s+(bomb|explosive)", "Explosive compound reference",
     "tatp or petn or rdx or explosive or nium", "what is PETN used for", "ammonium nitrate as fertilizer"),
    ("TOX-C06", r"(best|most\s+effective|painless|quickest)\s+(way|method|means)\s+to\s+(kill\s+myself|commit\s+suicide|end\s+my\s+life)", "Self-harm method request",
     "my or suicide & myself or suicide or life & best or effective or painless or quickest", "best way to end my life", "best way to live"),
    ("TOX-C07", r"(step\s+by\s+step|detailed)\s+(instructions?|guide|method)\s+(for|to)\s+(suicide|self-harm)", "Self-harm instruction request",
     "suicide or self-harm", "detailed guide to self-harm", "suicide prevention line"),
]

HIGH = [
    ("TOX-H01", r"(how\s+to\s+)?(synthesize|make|cook|produce|manufacture)\s+(methamphetamine|meth|fentanyl|heroin|cocaine|LSD|MDMA)", "Drug synthesis request",
     "meth or fentanyl or heroin or cocaine or lsd or mdma & synthesize or make or cook or produce or manufacture", "cook meth at home", "heroin use is rising"),
    ("TOX-H02", r"(drug\s+synthesis|clandestine\s+lab|one-pot\s+meth)", "Drug synthesis reference", "synthesis or clandestine or meth", "a clandestine lab", "a clandestine love"),
    ("TOX-H03", r"(write|create|build|code)\s+(me\s+)?(a\s+)?(ransomware|keylogger|rootkit|RAT\s+(tool|trojan)|botnet)", "Malware creation request",
     "ransomware or keylogger or rootkit or rat or botnet & write or create or build or code", "write me a keylogger", "a keylogger was found"),
    ("TOX-H04", r"(how\s+to\s+)?(hack|compromise)\s+into\s+(someone('s)?|a\s+person's|my\s+[\w\-]+'s?)", "Targeted attack request",
     "into & hack or compromise", "hack into my brother's phone", "hack into the show"),
    ("TOX-H05", r"break\s+into\s+(someone('s)?|a\s+person's|my\s+[\w\-]+'s?)", "Targeted attack request", "into & break", "break into someone's car", "break into song"),
    ("TOX-H06", r"(exploit|payload)\s+(for|targeting)\s+(CVE-\d{4}-\d+)", "Exploit code request", "cve-", "exploit for CVE-2024-1234", "CVE-2024-1234 was fixed"),
    ("TOX-H07", r"(all|every|most)\s+(jews?|muslims?|christians?|hindus?|blacks?|whites?|asians?)\s+(are|should\s+be|deserve\s+to\s+be|should\s+die)", "Hate speech pattern",
     "jew or muslim or christian or hindu or black or white or asian & are or should or deserve", "the claim that all whites are the same", "white walls"),
    ("TOX-H08", r"(find|get|locate)\s+(the\s+)?(home\s+address|personal\s+details|private\s+information)\s+(of|for|about)\s+", "Doxxing request",
     "address or details or private & find or get or locate", "locate the home address of him", "find a home"),
    ("TOX-H09", r"(stalk|track|follow|surveil)\s+(someone|a\s+person|my\s+ex|him|her)\s+(without|covertly|secretly)", "Stalking facilitation",
     "without or covertly or secretly & stalk or track or follow or surveil", "track someone secretly", "track a parcel"),
]

MEDIUM = [
    ("TOX-M01", r"(how\s+to\s+)?(get|obtain|buy|acquire)\s+(illegal\s+)?(guns?|firearms?|weapons?)\s+(illegally|without\s+(background\s+check|license|permit))", "Illegal weapons acquisition",
     "gun or firearm or weapon & get or obtain or buy or acquire", "buy guns without license", "buy a water gun"),
    ("TOX-M02", r"(how\s+to\s+)?(shoplift|steal|rob|pickpocket)\s+without\s+(getting\s+caught|detection)", "Theft facilitation",
     "without & shoplift or steal or rob or pickpocket", "shoplift without detection", "steal a glance"),
    ("TOX-M03", r"(how\s+to\s+)?(launder|wash)\s+(money|funds|cash)", "Money laundering request", "launder or wash & money or funds or cash", "launder funds abroad", "wash the cup"),
    ("TOX-M04", r"(create|forge|fake)\s+(id(entification)?|passport|driver'?s?\s+license|document)", "Document forgery request",
     "create or forge or fake & id or passport or license or document", "forge passport pages", "create a garden"),
]


def rules() -> list[Rule]:
    rows = [
        Rule(rid, "toxic", regex, ZERO_TOLERANCE_TEXT, "critical", 1.0, "toxic",
             flags="i", shape="hidden", needs=needs, hit=hit, miss=miss)
        for rid, regex, needs, hit, miss in ZERO_TOLERANCE
    ]
    rows += [
        Rule(rid, "toxic", regex, desc, severity, conf, "toxic", flags="is", needs=needs, hit=hit, miss=miss)
        for group, severity, conf in ((CRITICAL, "critical", 0.90), (HIGH, "high", 0.80), (MEDIUM, "medium", 0.70))
        for rid, regex, desc, needs, hit, miss in group
    ]
    return rows
