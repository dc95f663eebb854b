"""Word lists and patterns of the domain's classifiers. All fixed values."""

POSITIVE = {
    "strong": 0.8, "excellent": 0.9, "good": 0.7, "positive": 0.6, "growth": 0.7, "profitable": 0.8, "successful": 0.8, "opportunity": 0.6, "innovative": 0.7, "leading": 0.7,
    "market leader": 0.8, "competitive advantage": 0.8, "scalable": 0.7, "sustainable": 0.7, "robust": 0.7, "solid": 0.6, "impressive": 0.8, "outstanding": 0.9, "favorable": 0.6, "promising": 0.7,
}
NEGATIVE = {
    "weak": -0.8, "poor": -0.7, "negative": -0.6, "decline": -0.7, "loss": -0.8, "risk": -0.6, "risky": -0.7, "uncertain": -0.5, "volatile": -0.6, "concern": -0.5, "problem": -0.6,
    "issue": -0.5, "challenge": -0.4, "difficult": -0.5, "struggling": -0.7, "failing": -0.9, "bankruptcy": -0.9, "debt": -0.6, "liability": -0.5, "burden": -0.5, "threat": -0.7,
}
#: (level, pattern, score)
RISKS = [
    ("high", "bankruptcy|insolvency|liquidation", 0.9), ("high", "default.*on.*loan|loan.*default", 0.8), ("high", "negative.*cash.*flow|cash.*flow.*negative", 0.8), ("high", "burn.*rate.*high|high.*burn.*rate", 0.7), ("high", "debt.*to.*equity.*high|high.*debt.*ratio", 0.7),
    ("medium", "decline|decreasing|falling", 0.5), ("medium", "challenge|difficulty|problem", 0.4), ("medium", "uncertain|uncertainty", 0.4), ("medium", "concern|worry", 0.3), ("medium", "volatile|volatility", 0.5),
    ("low", "stable|steady", 0.2), ("low", "manageable|controlled", 0.2), ("low", "moderate|reasonable", 0.1),
]
RISK_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
RISK_CATEGORIES = [
    ("financial", ["debt", "liability", "cash flow", "burn rate", "runway", "default"]), ("market", ["competition", "market share", "saturation", "disruption"]), ("operational", ["scalability", "dependencies", "single point of failure"]),
    ("regulatory", ["compliance", "regulation", "legal", "license"]), ("technical", ["technology risk", "obsolescence", "security"]),
]
INTERESTED = [
    "interested", "yes", "definitely", "absolutely", "let's proceed", "move forward", "schedule a call", "meet", "discuss further", "would like to", "keen", "excited", "opportunity", "potential", "willing to", "ready to", "onboard", "partner", "collaborate",
    "invest", "funding", "capital", "back", "support", "growth", "next steps", "send details", "learn more", "tell me more", "impressive", "promising", "strong", "solid", "good fit", "aligns", "matches", "perfect", "ideal", "excellent",
]
NOT_INTERESTED = [
    "not interested", "not looking", "pass", "decline", "reject", "unfortunately", "sorry", "regret", "not a fit", "not aligned", "different focus", "outside", "doesn't match", "not the right", "not at this time", "not currently", "no thanks", "not for us",
    "skip", "maybe next time", "future rounds", "too early", "too late", "wrong stage", "different sector", "competitor", "conflict", "passing", "not pursuing", "closing", "stopped",
]
PENDING = [
    "maybe", "possibly", "consider", "think about it", "review", "get back to you", "follow up", "circle back", "discuss", "need time", "need more info", "questions", "concerns", "hesitant", "uncertain", "undecided", "weighing", "evaluating",
    "assessing", "analyzing", "comparing", "waiting", "on hold", "paused", "delayed", "postponed", "revisit",
]
INVESTOR = [
    "investor", "vc", "venture capital", "angel", "fund", "lp", "general partner", "check", "term sheet", "due diligence", "valuation", "equity", "stake", "ownership", "roi", "return", "portfolio", "fund", "capital", "financing", "round",
    "seed", "series a", "series b", "pre-seed", "early stage", "growth stage", "late stage", "exit", "acquisition",
]
CLIENT = [
    "client", "customer", "user", "pilot", "trial", "demo", "purchase", "buy", "contract", "agreement", "license", "subscription", "service", "product", "solution", "implementation", "deployment", "integration", "api", "price", "pricing", "cost", "budget", "invoice",
]
EMAIL_INTENTS = [
    ("interested", ["interested", "love to learn", "exciting", "impressed", "opportunity", "invest"]), ("not_interested", ["not a fit", "pass", "decline", "not interested", "moving forward without"]),
    ("due_diligence", ["due diligence", "financials", "data room", "cap table", "metrics", "audit"]), ("follow_up", ["follow up", "checking in", "following up", "any update", "status"]),
    ("introduction", ["introduction", "introduce", "reaching out", "hello", "hi team"]), ("question", ["question", "clarify", "can you explain", "what is", "how does"]),
]
EMAIL_SENDERS = [("investor", ["vc", "fund", "capital", "investment", "investor"]), ("startup", ["startup", "founder", "ceo", "company", "product"])]
#: (intent, recommendation, days, priority, action)
FOLLOW_UPS = [
    ("interested", "PROCEED", 2, "high", "Schedule founding team call"), ("interested", "CONSIDER", 3, "high", "Request additional financials"), ("interested", "WATCH", 7, "medium", "Monitor and re-evaluate next quarter"), ("interested", "PASS", 0, "low", "Send polite decline"),
    ("due_diligence", "PROCEED", 1, "high", "Send data room request"), ("due_diligence", "CONSIDER", 2, "high", "Request cap table + customer references"), ("follow_up", "PROCEED", 1, "high", "Respond immediately"), ("follow_up", "CONSIDER", 3, "medium", "Provide status update"),
    ("not_interested", "PASS", 0, "low", "Log as passed — no followup"), ("introduction", "WATCH", 14, "low", "Add to watchlist — revisit in 2 weeks"),
]
CONTEXTS = [
    ("company", ["company|corporation|inc\\.?|llc|ltd\\.?|corp\\.?|enterprise|business|firm|startup", "ceo|cto|cfo|founder|executive|management|team|employee", "headquarters|office|location|region|market presence"]),
    ("deal", ["series [a-d]|seed round|angel|venture capital|vc|funding|investment|investor", "term sheet|due diligence|valuation|cap table|equity|stake|shares", "acquisition|merger|ipo|exit|buyout|takeover", "deal|transaction|negotiation|offer|proposal|partnership"]),
    ("market", ["market|industry|sector|segment|niche|vertical|competitor|competition", "trend|growth|decline|opportunity|threat|swot|positioning", "market share|penetration|adoption|demand|supply"]),
    ("financial", ["revenue|profit|loss|earnings|income|expense|cost|margin", "ebitda|cash flow|balance sheet|income statement|p&l", "million|billion|k|usd|\\$|€|£|inr", "growth rate|cagr|projection|forecast|budget", "pe ratio|eps|roe|roi|npv|irr|wacc"]),
]
TOPICS = [
    ("valuation", ["valuation", "worth", "price", "multiple", "ev/ebitda", "p/e"]), ("revenue", ["revenue", "sales", "top line", "turnover", "income"]), ("growth", ["growth", "expansion", "scaling", "increase", "upward"]),
    ("risk", ["risk", "concern", "challenge", "issue", "problem", "threat"]), ("opportunity", ["opportunity", "potential", "prospect", "advantage"]), ("team", ["team", "founder", "talent", "hiring", "retention", "culture"]),
    ("product", ["product", "technology", "innovation", "feature", "roadmap"]), ("market", ["market", "customer", "user", "adoption", "demand"]),
]
CONTEXT_POSITIVE = ["good", "great", "excellent", "positive", "strong", "growth", "profit", "success", "opportunity", "advantage"]
CONTEXT_NEGATIVE = ["bad", "poor", "negative", "weak", "decline", "loss", "risk", "problem", "concern", "challenge"]
EXPIRY_DAYS = [("market", 30), ("financial", 90), ("deal", 180), ("company", 365)]
CHUNK_TYPES = [
    ("financials", ["revenue", "arr", "mrr", "burn", "runway", "funding", "valuation", "ebitda", "margin", "profit", "loss", "financial", "unit economics", "cagr", "growth rate", "$", "million", "billion", "k", "crore", "lakh"]),
    ("team", ["founder", "ceo", "cto", "cfo", "team", "founding", "background", "experience", "worked at", "former", "led", "managed", "team size", "employees", "headcount", "hiring"]),
    ("market", ["tam", "sam", "som", "market size", "industry", "sector", "competitor", "competition", "landscape", "trends", "addressable market", "target market", "customer"]),
    ("product", ["product", "solution", "platform", "feature", "technology", "patent", "ip", "prototype", "mvp", "demo", "launch", "use case", "workflow", "integration", "api"]),
]
INDUSTRIES = {
    13: [
        ("mobility", ["electric vehicle", "ev rental", "bike rental", "scooter", "last-mile", "fleet", "mobility", "bijliride", "transportation", "logistics", "delivery"]), ("agritech", ["agritech", "agriculture", "farming", "agri", "crop", "soil"]),
        ("edtech", ["edtech", "education", "learning", "teaching", "online education", "e-learning"]), ("healthcare", ["healthcare", "health", "medical", "pharma", "biotech", "clinical", "patient"]),
        ("energy", ["energy", "renewable", "solar", "wind", "clean energy", "battery"]), ("fintech", ["fintech", "financial technology", "payments", "banking", "neobank", "lending"]),
        ("hr tech", ["hr tech", "hiring", "recruiting", "recruitment", "talent", "workforce", "human resources"]), ("ecommerce", ["ecommerce", "e-commerce", "retail", "marketplace", "shopping", "d2c"]),
        ("ai/ml", ["artificial intelligence", "machine learning", "deep learning", "ai co-pilot", "vertical ai", "generative ai"]), ("manufacturing", ["manufacturing", "factory", "production", "assembly", "industrial"]),
        ("b2b", ["b2b", "business to business", "enterprise software"]), ("consumer", ["b2c", "consumer", "direct to consumer"]), ("saas", ["saas", "software as a service", "subscription", "recurring revenue", "platform"]),
    ],
    8: [
        ("hr tech", ["hr", "hiring", "recruiting", "recruitment", "talent", "workforce", "human resources"]), ("ai/ml", ["artificial intelligence", "machine learning", "ai", "ml", "deep learning", "ai co-pilot", "vertical ai"]),
        ("fintech", ["fintech", "financial technology", "payments", "banking", "finance"]), ("healthcare", ["healthcare", "health", "medical", "pharma", "biotech"]), ("saas", ["saas", "software as a service", "software", "platform"]),
        ("ecommerce", ["ecommerce", "e-commerce", "retail", "marketplace", "shopping"]), ("agritech", ["agritech", "agriculture", "farming", "agri"]), ("mobility", ["mobility", "transportation", "logistics", "delivery", "electric vehicle", "ev"]),
    ],
    6: [
        ("FinTech", ["fintech", "payments", "banking", "lending", "insurance"]), ("HealthTech", ["healthcare", "health tech", "medtech", "clinical", "patient"]), ("SaaS", ["saas", "software", "enterprise software", "workflow"]),
        ("Mobility", ["mobility", "vehicle", "ev", "transportation", "fleet"]), ("E-commerce", ["e-commerce", "marketplace", "retail", "shopping"]), ("AI", ["artificial intelligence", "machine learning", "llm", "generative ai"]),
    ],
}
STAGES = ["pre-seed", "preseed", "angel", "seed", "series a", "series b", "series c", "series d", "early stage", "growth stage", "late stage"]
EARLY = ["prototype", "mvp", "minimum viable product", "beta", "pilot", "launching", "just launched", "pre-revenue", "pre revenue", "seeking seed", "raising seed", "seed round", "pre-series"]
GROWTH = ["series a", "series b", "scaling", "expanding", "growing", "traction", "customers", "users", "revenue", "arr", "mrr"]
DOC_TYPES = [
    ("financial", ["revenue", "sales", "income", "financial", "profit", "loss", "margin", "ebitda", "cash flow"]), ("pitch", ["pitch", "investment", "funding", "venture", "startup", "business model", "traction", "market size"]),
    ("nda", ["agreement", "confidential", "nda", "terms", "legal"]),
]
BUSINESS_MODELS = [("saas", "saas|software *as *a *service|subscription|recurring *revenue"), ("marketplace", "marketplace|platform|two-sided *market"), ("b2b", "b2b|business *to *business"), ("freemium", "freemium|free *trial|basic *plan")]
FINANCE_TERMS = ["revenue", "growth", "profit", "margin", "arr", "mrr", "ebitda", "users", "customers", "market", "funding", "valuation"]
#: Ordered patterns of the deck metrics (one group each), run without regard to case.
MONEY = r"\$[0-9][0-9,.]*[0-9]*(?: ?[KMB])?"
DECK_PATTERNS = {
    "revenue": [rf"(?i)(?:arr|annual recurring revenue|revenue|sales) *[:\-]? *({MONEY})", rf"(?i)({MONEY}) *(?:arr|in revenue|revenue run rate|annual revenue)", rf"(?i)mrr *[:\-]? *({MONEY})"],
    "growth_rate": [r"(?i)([0-9]+(?:\.[0-9]+)?(?:%|x) *(?:YoY|year over year|growth|CAGR))", r"(?i)(?:growth|grew|increased?) *(?:by|of)? *([0-9]+(?:\.[0-9]+)?(?:%|x))", r"(?i)([0-9]+(?:\.[0-9]+)?% *(?:retention|occupancy))"],
    "users": [r"(?i)(?:users|customers|clients|subscribers|members) *[:\-]? *([0-9][0-9,]*(?: ?[KMB])?)", r"(?i)([0-9][0-9,]*(?: ?[KMB])?) *(?:monthly active users|active users|users|customers|clients|subscribers)"],
    "market_size": [rf"(?i)(?:TAM|SAM|SOM|market size) *[:\-]? *({MONEY})", rf"(?i)({MONEY}) *(?:TAM|SAM|SOM|market opportunity|market size)"],
    "stage": [r"(?i)\b(Pre-Seed|Seed|Series A|Series B|Series C|Series D|Growth Stage|Pre-Series A)\b"],
    "funding": [rf"(?i)(?:raising|seeking|fundraising|round) *[:\-]? *({MONEY})", rf"(?i)({MONEY}) *(?:round|raise|fundraise)"],
    "company": [r"(?i)(?:company name|startup|company) *[:\-] *([A-Z][A-Za-z0-9&,\-# ]{1,60})"],
}
DECK_CONFIDENCE = {"revenue": 0.55, "growth_rate": 0.45, "users": 0.45, "market_size": 0.4, "stage": 0.65, "funding": 0.5}
MINED_PATTERNS = {
    "revenue": [r"(?i)\$?([0-9]+\.?[0-9]*[MBK]) *(?:revenue|ARR|MRR|turnover)", r"(?i)(?:revenue|ARR|MRR) *(?::|=)? *\$?([0-9]+\.?[0-9]*[MBK])"],
    "growth_rate": [r"(?i)([0-9]+%) *(?:growth|YoY|MoM|CAGR)", r"(?i)(?:growth|YoY) *(?::|=)? *([0-9]+%)"],
    "market_size": [r"(?i)\$?([0-9]+\.?[0-9]*[TMB]) *(?:TAM|market size|SAM)", r"(?i)(?:TAM|market size) *(?::|=)? *\$?([0-9]+\.?[0-9]*[TMB])"],
}
FOUNDER_PATTERNS = [r"founders?\s*[:\-]\s*([^\n]{3,50})", r"team\s*[:\-]\s*([^\n]{3,50})", r"ceo\s*[:\-]\s*([^\n]{3,50})", r"co[-\s]?founders?\s*[:\-]\s*([^\n]{3,50})"]
#: How the opening of a deck names its company, in order of trust; words that aren't names; words of other title lines.
NAME_PATTERNS = [
    r"(?im)^([^\n\-|–—]+)\s*[\-|–—]\s*(?:pitch\s*deck|presentation|deck)", r"(?im)about\s+([A-Z][A-Za-z0-9\s&]+?)(?:\s|$|\.|:)", r"(?im)^([A-Z][A-Za-z0-9\s&]+?)\s+is\s+a\s+(?:\w+\s+)?(?:company|startup|platform|solution|service)",
    r"(?im)\n([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\s*\n", r"(?im)welcome\s+to\s+([A-Z][A-Za-z0-9\s&]+?)(?:\s|$|!|\.)", r"(?im)(?:meet\s+the\s+team|team)\s+(?:at\s+|of\s+)?([A-Z][A-Za-z0-9\s&]+?)(?:\s|$|\.)", r"(?im)(?:www\.|https?://)?([a-z0-9\-]+)\.(?:com|io|ai|co|app)",
]
NOT_NAMES = ["the", "and", "for", "our", "this", "we", "us", "your", "about", "meet", "team", "welcome"]
NOT_TITLES = ["confidential", "proprietary", "slide", "page", "agenda", "outline", "contents"]
#: Patterns of the insights on a document, one group each; what the report says if any of a list is found.
FIGURES = [r"(\$[0-9,]+\.?[0-9]*[kmb]?|[0-9]+\.?[0-9]*[kmb]?)", r"([0-9]+(?:,[0-9]{3})*\s*(?:million|billion|thousand|m|k|bn))", r"(revenue[:\s]*\$?[0-9,]+)", r"((?:revenue|sales|income)\s*:\s*\$?[0-9,]+)"]
INSIGHTS = [
    ("growth", "Growth metrics and KPIs detected", [r"([0-9]+\.?[0-9]*)%\s*(?:growth|increase|yoy)", r"(growth\s*rate|yoy|year\s*over\s*year)", r"(quarter\s*[0-9]{4}|q[1-4])", r"(annual\s*|yearly|fy)"]),
    ("technical", "Technical and operational metrics found", [r"((?:users?|customers?|active\s*users?)\s*:\s*[0-9]+)", r"((?:churn|retention|lifecycle|ltv)\s*:\s*[0-9]+%)", r"((?:conversion|activation|adoption)\s*rate\s*:\s*[0-9]+%)", r"(arpu|arpa|ltv|cac)\s*:\s*\$?[0-9]+", r"((?:moic|ltv|cac\s*ratio)\s*:\s*[0-9.]+)"]),
    ("market", "Market and competitive analysis detected", [r"((?:market\s*size|tam|sam|som)\s*:\s*\$?[0-9]+[btm]?)", r"((?:competition|competitive|industry)\s*(?:analysis|landscape))", r"((?:market\s*share|penetration|growth)\s*:\s*[0-9]+%)"]),
    ("risk", "Risk and challenge indicators found", [r"((?:risk|challenge|concern|issue)\s*(?:analysis|assessment))", r"(burn\s*rate|runway|cash\s*burn)", r"((?:debt|liability|obligation)\s*(?:analysis|structure))"]),
]
TEAM_SIZE_PATTERNS = [r"([0-9]+) *(?:person|people|employee|team)", r"team *(?:of *)?([0-9]+)"]

#: What a mail is also searched for.
MAIL_TERMS = ["revenue", "arr", "mrr", "growth", "funding", "valuation", "runway", "burn", "series", "seed", "investment", "return", "profit", "ebitda", "margin", "cagr", "tam", "sam"]
#: Advice on a document's figures and charts: on many or few terms, on many or no charts.
VISUAL_ADVICE = ["Strong financial data presentation", "Consider adding more financial metrics", "Good use of data visualization", "Consider adding charts to illustrate key points"]

#: Fixed value: how a mail names a company.
MAIL_COMPANY = r"(?:company|startup|firm)[ \t\n]+(?:is[ \t\n]+)?([A-Z][a-zA-Z]+)"
