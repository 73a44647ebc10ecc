"""Rule lists, weights and title patterns that decide results. Patterns are case-insensitive."""

from __future__ import annotations

# --- fixed values ------------------------------------------------------------------

BLOCKED_SOURCES = ["hn_hiring"]

TITLE_REJECT = {
    "non_technical": [
        r"\baccount (executive|manager|director)\b", r"\b(sales|presales|pre-sales)\b", r"\bbusiness development\b",
        r"\brecruit(er|ing|ment)\b", r"\b(counsel|attorney|paralegal|legal)\b", r"\bmarketing\b",
        r"\bcustomer (success|experience|support)\b", r"\bprocurement\b", r"\bsupply (chain|planner)\b",
        r"\bsourcing\b", r"\bdesigner\b", r"\b(product|program|project) manager\b",
        r"\bsolutions? (consultant|architect)\b", r"\bsolutions? engineer\b", r"\btechnical writer\b",
        r"\bnurse|physician|clinical\b", r"\bcontroller\b", r"\bchief \w+ officer\b",
    ],
    "senior": [
        r"\b(senior|sr\.?|staff|principal|distinguished|lead|head of|director|vp|vice president)\b",
        r"\b(engineer|developer|scientist|programmer)\s+(iii|iv|v|vi)\b", r"\bl[4-9]\b",
    ],
    "quant": [
        r"\bquant(itative)?\b", r"\btrader\b", r"\btrading (desk|operations)\b",
    ],
    "temporary": [
        r"\bintern(ship)?s?\b", r"\bco[\s-]?op\b", r"\bapprentice(ship)?\b",
        r"\bsummer (analyst|associate|scholar)\b", r"\bplacement year\b",
        r"\b(part[\s-]time|contract|temporary|seasonal)\b",
    ],
    "wrong_cohort": [
        r"\bnew\s*grad(uate)?s?\b[^a-z0-9]{0,4}\b20(1\d|2[0-6])\b", r"\bclass of 20(1\d|2[0-6])\b",
        r"\b20(1\d|2[0-6])\s+(new\s*grad|graduates?)\b",
    ],
    "not_software": [
        r"\btechnician\b", r"\bmanufacturing\b", r"\bcalibration\b",
        r"\b(electrical|mechanical|aerospace|aerostructures|industrial|chemical) engineer\b", r"\brf engineer\b",
        r"\bsupplier quality\b",
    ],
}

LOCATION_ALLOW = [
    r"\bremote\b", r"\bnew york\b", r"\bnyc\b", r"\bn\.?y\.?c\b", r"\bmanhattan\b", r"\bbrooklyn\b", r"\bqueens\b",
    r"\blong island\b", r"\bny\b", r"\buniondale\b", r"\bplainview\b", r"\bbethpage\b", r"\bmelville\b",
    r"\bjersey city\b", r"\bnewark\b", r"\bhoboken\b", r"\bnj\b", r"\bflorida\b", r"\bfl\b", r"\bmiami\b",
    r"\btampa\b", r"\borlando\b", r"\bvirginia\b", r"\bva\b", r"\breston\b", r"\barlington\b", r"\bmclean\b",
    r"\bherndon\b", r"\bboston\b", r"\bmassachusetts\b", r"\bma\b", r"\bcambridge\b", r"\bwaltham\b", r"\bquincy\b",
    r"\bmaynard\b", r"\bcolorado\b", r"\bco\b", r"\bdenver\b", r"\bboulder\b", r"\bbroomfield\b",
    r"\bcolorado springs\b", r"\bfort collins\b", r"\bswitzerland\b", r"\bzurich\b", r"\bz\u00fcrich\b",
    r"\bbasel\b", r"\blausanne\b", r"\blucerne\b", r"\bzug\b", r"\bgeneva\b", r"\bspain\b", r"\bmadrid\b",
    r"\bbarcelona\b", r"\bvalencia\b",
]

LOCATION_DENY = [
    r"\bcalifornia\b", r"\bca\b", r"\bsan francisco\b", r"\bsf\b", r"\bsan mateo\b", r"\bmenlo park\b",
    r"\bpalo alto\b", r"\bmountain view\b", r"\bsunnyvale\b", r"\bsan jose\b", r"\bfoster city\b", r"\bmilpitas\b",
    r"\boakland\b", r"\birvine\b", r"\bcosta mesa\b", r"\bglendale\b", r"\blos angeles\b", r"\bsan diego\b",
    r"\bseattle\b", r"\bbellevue\b", r"\bkirkland\b", r"\bwashington state\b", r"\bwa\b", r"\boregon\b",
    r"\bportland\b", r"\baustin\b", r"\bdallas\b", r"\bhouston\b", r"\btexas\b", r"\btx\b", r"\bplano\b",
    r"\bchicago\b", r"\billinois\b", r"\bil\b", r"\bnorth carolina\b", r"\bnc\b", r"\bcary\b", r"\braleigh\b",
    r"\bdurham\b", r"\brtp\b", r"\bohio\b", r"\boh\b", r"\bcolumbus\b", r"\bdelaware\b", r"\bde\b",
    r"\bwilmington\b", r"\bgeorgia\b", r"\batlanta\b", r"\barizona\b", r"\bphoenix\b", r"\butah\b", r"\bminnesota\b",
    r"\bwisconsin\b", r"\bmadison\b", r"\bpittsburgh\b", r"\bpennsylvania\b", r"\balabama\b", r"\bhuntsville\b",
    r"\brhode island\b", r"\bquonset\b", r"\btoronto\b", r"\bcanada\b", r"\bbelgium\b", r"\bdenmark\b",
    r"\bbrazil\b", r"\bs\u00e3o paulo\b", r"\bsao paulo\b", r"\blatam\b", r"\bindia\b", r"\bbangalore\b",
    r"\bunited kingdom\b", r"\blondon\b", r"\bgermany\b", r"\bberlin\b", r"\bmunich\b", r"\bfrance\b", r"\bparis\b",
    r"\bnetherlands\b", r"\bamsterdam\b", r"\bireland\b", r"\bdublin\b", r"\bpoland\b", r"\bportugal\b",
    r"\blisbon\b", r"\bmexico\b", r"\bargentina\b", r"\bsingapore\b", r"\bjapan\b", r"\btokyo\b", r"\baustralia\b",
    r"\bsydney\b",
]

SKILLS = [
    "Python", "Linux", "web scraping", "Java", "JavaScript", "TypeScript", "Node.js", "React", "React Native", "C#",
    "ASP.NET Core", "SQL", "Bash", "Terraform", "Docker", "Azure", "REST APIs", "Git", "Prometheus", "Grafana",
    "RAG pipelines", "vector embeddings", "Ollama", "pandas", "JUnit", "pytest", "Qdrant",
]

ROLE_FAMILIES = ["software_engineering", "security", "ml_ai", "data", "infra_devops", "other_technical", "non_technical"]
SENIORITIES = ["intern", "new_grad", "junior", "mid", "senior_plus", "unclear"]
START_TIMINGS = ["2027_or_later", "2026_or_earlier", "unclear"]

FAMILY_BASE = {"software_engineering": 5, "security": 5, "ml_ai": 5, "data": 4, "infra_devops": 5, "other_technical": 2, "non_technical": 0}
SENIORITY_DELTA = {"new_grad": 2, "junior": 1, "unclear": 1, "mid": -3, "intern": 0, "senior_plus": 0}
START_DELTA = {"2027_or_later": 1, "unclear": 0, "2026_or_earlier": 0}

NEW_GRAD_TITLE = (
    r"new[\s\-]?grad(uate)?\b|entry[\s\-]level\b|\b2027\b|summer\s+2027|university\s+(recruit|hiring|grad)"
    r"|graduate\s+(program|engineer|rotational)\b|campus\s+(recruit|hire|hiring)|early[\s\-]career"
)
INTERNSHIP_TITLE = (
    r"\bintern(ship)?s?\b|\bco[\s\-]?op\b|\bapprentice(ship)?\b|\bsummer\s+(analyst|associate|scholar)\b"
    r"|\bplacement\s+year\b|\bindustrial\s+placement\b"
)

PLACES_KEPT = [
    "new york", "nyc", "long island", "manhattan", "brooklyn", "florida", "virginia", "boston", "massachusetts",
    "colorado", "denver", "switzerland", "zurich", "riva", "spain", "san francisco", "bay area", "palo alto", "remote",
    "united states",
]
PLACES_FIRST = ["new york", "nyc", "long island", "manhattan", "brooklyn"]
PLACES_SECOND = ["florida", "virginia", "boston", "massachusetts", "colorado", "denver", "switzerland", "zurich", "riva", "spain"]

SENIOR = r"\b(senior|sr\.?|staff|principal|\blead\b|manager|director|\bhead\b|\bvp\b|vice president|chief|architect|fellow)\b"
LEVEL_3 = r"engineer\s*(3|iii)\b"
YEARS = r"(\d+)\s*\+?\s*(?:[-–]\s*\d+\s*)?\s*(?:years|yrs|yoe)\b"
PHD = r"\bph\.?\s*d\b"
GRAD_RESCUE = (
    r"new\s*grad|entry[- ]level|\bintern(ship)?\b|university (grad|program)|graduate (program|engineer|rotational)"
    r"|\bgrad program\b|2027 grad|co[- ]?op\b"
)
WRONG_CYCLE = (
    r"grad\w*\s+before\s+may\s+2027|before may 2027|fall\s*2026\s*start|summer\s*2026|experienced professionals"
)
DEGREE = r"\b(ms|m\.s\.|master'?s|phd|ph\.d\.)\b[^.]*\brequired"
HARD_OTHER = (
    r"account executive|account manager|\bsales\b|sales engineer|solutions? engineer|business development"
    r"|partner development|\brepresentative\b|\brecruiter\b|\bsourcer\b|\btalent\b|\battorney\b|\bcounsel\b|\blegal\b"
    r"|\bmarketing\b|product designer|gtm engineer|developer advocate|\badvocate\b|community growth|revenue enablement"
    r"|\benablement\b|\bconsultant\b|customer success|customer experience|people ops|ai trainer"
)
SOFT_OTHER = (
    r"\banalyst\b|\bscientist\b|\bresearcher\b|\bassociate\b|\boperations\b|\bcoordinator\b|\bspecialist\b"
    r"|\bstrategist\b|\btrader\b|\btrading\b|\btrainer\b|equity research|research analyst|data scientist"
    r"|applied scientist|research scientist|\bdesigner\b|\bfinance\b|fp&a|\binvestment\b|treasury|finops|fin ops"
    r"|business analyst|business systems|business automation|ops analyst|\bbilling\b|accounts receivable|\bproducer\b"
    r"|\beducator\b|\bcompliance\b|product manage|program manage|customer data|\bsalesforce\b|support engineer"
    r"|technical support|solutions? architect"
)
ENGINEERING = r"software engineer|design engineer|full[- ]?stack|backend|front[- ]?end|web application"
QUANT = r"quantitative (trader|researcher|analyst)|quant researcher"
QUANT_RESCUE = r"developer|intern|new grad"
MENTIONS_2027 = r"2027|summer 2027|2027 grad"
TIERS = [
    r"security|appsec|infosec|vulnerability",
    r"applied ai|ai engineer|machine learning|\bml\b|ml ops|mlops|\bnlp\b|\bllm\b|gen ?ai|ai platform",
    r"devops|platform engineer|site reliability|\bsre\b|infrastructure|reliability engineer|linux engineer"
    r"|environment platform|apollo|cloud operations",
    r"software engineer|full[- ]?stack|backend|front[- ]?end|web application|developer",
]

EXPORT_COLUMNS = {
    "Score": "score", "Job Title": "title", "Company": "company", "Location": "location", "Pay": "salary",
    "My Pay": "pay", "Website": "url", "Date Found": "date_processed", "Date Applied": "date_applied", "Why": "reason",
    "Matched Skills": "matched_skills", "Concerns": "concerns", "Application ID": "application_id",
    "Cover Letter": "cover_letter", "Due Date": "due_date", "Round #": "round_num", "Status": "status",
    "As of": "as_of", "Notes": "notes",
}
PLATFORMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee"]
LIST_LABELS = {
    "company": "company", "employer": "company", "organization": "company", "role": "title", "position": "title",
    "title": "title", "job title": "title", "location": "location", "locations": "location", "application": "url",
    "application/link": "url", "application link": "url", "apply": "url", "apply link": "url", "link": "url",
    "links": "url", "posting": "url", "postings": "url", "salary": "salary", "compensation": "salary",
    "pay": "salary", "date posted": "posted", "date": "posted", "posted": "posted", "age": "posted",
}
