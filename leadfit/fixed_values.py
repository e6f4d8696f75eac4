"""Fixed values.

Word lists, patterns, labels and limits that decide results. They are plain data:
every operator takes them from here, and most take an override as a parameter.
"""

from __future__ import annotations

# --- fixed values: lead file headers -> canonical field, in order of preference ---
HEADER_ALIASES = {
    "name": ["company", "company name", "business name", "name", "organization", "account name", "business"],
    "website": ["website", "url", "domain", "company website", "web", "site", "company domain name", "website url"],
    "city": ["city", "town"],
    "state": ["state", "state/region", "region", "province"],
    "industry": ["industry", "category", "sector", "vertical"],
    "employees": ["employees", "employee count", "number of employees", "headcount", "company size", "size"],
    "revenue_estimate": ["revenue", "estimated revenue", "revenue estimate", "annual revenue"],
    "owner_name": ["owner", "owner name", "contact name", "full name", "ceo", "founder", "contact"],
    "email": ["email", "email address", "owner email", "contact email"],
    "phone": ["phone", "phone number", "telephone", "company phone"],
}

# --- fixed values: company names, hosts, addresses, numbers ---
LEGAL_WORDS = r"\b(llc|l\.l\.c|inc|incorporated|co|corp|corporation|company|ltd|limited|pllc|pc|lp|the)\b"
HOST_PATTERN = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9-]{1,63})*\.[a-z]{2,24}$"
FREE_MAIL_HOSTS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
    "msn.com", "live.com", "comcast.net", "att.net", "sbcglobal.net", "verizon.net",
]
HOST_MAX_CHARS = 253  # by the rules of DNS; longer values are no hosts
EMAIL_MAX_CHARS = 320  # by the rules of mail
EMAIL_SYNTAX = r"^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}$"
ROLE_LOCAL_PARTS = [
    "info", "contact", "office", "admin", "sales", "support", "hello", "service", "team",
    "help", "billing", "careers", "jobs", "hr", "marketing", "noreply", "no-reply", "webmaster",
    "dispatch", "orders", "accounts", "reception", "estimates", "quotes",
]
DIRECT_EMAIL_STATUSES = ["valid", "personal_domain"]
GENERAL_EMAIL_STATUSES = ["role", "unverified"]

# --- fixed values: page fetching and page kinds ---
PAGE_KINDS = ["home", "about", "services", "contact", "careers"]
LINK_PATTERNS = {
    "about": r"about|our-story|history|who-we-are|our-team|meet",
    "services": r"services?|what-we-do|solutions|plans|maintenance",
    "contact": r"contact|locations?|get-in-touch",
    "careers": r"careers?|jobs|join|hiring|employment",
}
BLOCK_TITLES = r"just a moment|attention required|access denied|are you a robot|security check"
BLOCK_STATUSES = [401, 403, 429]
BLOCK_BODY = r"captcha|cf-chl|challenge"
RETRY_STATUSES = [429, 500, 502, 503, 504]
FRESH_HOURS = 72
BLOCKED_SITE_ERROR = "Site shows a bot check (CAPTCHA). Review it manually."
UNRESOLVED_HOST_ERROR = "Could not resolve host"
NO_FETCH_ERROR = "Request failed"
NO_WEBSITE_ERROR = "No website on record"

# --- fixed values: wording that carries a signal ---
FRANCHISE_PHRASES = (
    r"independently owned and operated franchise|franchise location|a franchise of|franchisee"
    r"|find a location near you|find your local|franchise opportunities|own a franchise|become a franchisee"
)
FRANCHISE_WEAK_PHRASES = r"locally owned and operated|independently owned and operated"
FRANCHISE_WORDS = r"franchise|franchisee|franchisor"
FRANCHISE_BRANDS = [
    "roto-rooter", "roto rooter", "mr. rooter", "mr rooter", "benjamin franklin plumbing",
    "one hour heating", "one hour air", "aire serv", "terminix", "servicemaster",
    "servpro", "molly maid", "merry maids", "the maids", "mosquito joe", "trugreen",
    "lawn doctor", "weed man", "chem-dry", "stanley steemer", "jan-pro", "jani-king",
    "anago", "mr. electric", "mr electric", "mr. handyman", "mr handyman",
    "glass doctor", "rainbow international", "ace handyman", "certapro",
    "five star painting", "budget blinds", "bath fitter", "precision garage door",
    "two men and a truck", "college hunks hauling junk", "1-800-got-junk", "junk king",
    "the cleaning authority", "pillar to post", "dryer vent wizard", "kitchen tune-up",
]
KEYWORD_PATTERNS = {
    "succession": r"retir(?:e|ing|ement)|succession|next chapter|business (?:is )?for sale"
                  r"|looking for (?:a|the right) (?:buyer|successor)|pass(?:ing)? the torch",
    "family_owned": r"family[- ]owned|family business|family[- ]run|second[- ]generation"
                    r"|third[- ]generation|father and son|mother and daughter",
    "hiring": r"we'?re hiring|now hiring|join our team|open positions|career opportunities",
    "franchise": FRANCHISE_PHRASES,
    "pe_backed": r"portfolio company|backed by .{0,40}(?:capital|partners|equity)|acquired by"
                 r"|a subsidiary of|part of the .{0,30} family of companies",
    "testimonials": r"testimonials?|what our customers say|reviews?|5[- ]star",
}
RECURRING_PATTERN = (
    r"maintenance (?:plan|agreement|program|membership)s?|service (?:agreement|contract|plan)s?|membership"
    r"|subscription|monthly (?:plan|service)|annual (?:service|contract|inspection)s?|recurring|retainer"
    r"|managed services"
)
# lower-case words of which each match above holds at least one: a cheap test before the pattern
PATTERN_STEMS = {
    "succession": ["retir", "succession", "next chapter", "for sale", "looking for", "torch"],
    "family_owned": ["family", "generation", "father and son", "mother and daughter"],
    "hiring": ["hiring", "join our team", "open positions", "career opportunities"],
    "franchise": ["franchise", "find a location near you", "find your local"],
    "pe_backed": ["portfolio company", "backed by", "acquired by", "subsidiary of", "part of the"],
    "testimonials": ["testimonial", "what our customers say", "review", "5-star", "5 star"],
    "recurring": ["maintenance ", "service ", "membership", "subscription", "monthly ", "annual ", "recurring",
                  "retainer", "managed services"],
    "weak_franchise": ["owned and operated"],
}
INDUSTRY_PATTERNS = {
    "HVAC": r"hvac|heating|air condition|furnace",
    "Plumbing": r"plumb|drain|water heater",
    "Electrical": r"electrician|electrical contractor",
    "Roofing": r"roofing|roofer",
    "Landscaping": r"landscap|lawn care",
    "Pest control": r"pest control|exterminat|termite",
    "Commercial cleaning": r"janitorial|commercial cleaning",
    "Accounting": r"accounting|bookkeeping|cpa firm|tax preparation",
    "IT services": r"managed it|it support|managed services provider|cybersecurity",
    "Manufacturing": r"manufactur|machining|fabrication|cnc",
    "Logistics": r"freight|trucking|logistics|warehous",
    "Dental": r"dental|dentist",
    "Auto repair": r"auto repair|collision|mechanic",
    "Marketing agency": r"marketing agency|digital marketing|seo services",
}
FOUNDED_PATTERN = (
    r"\b(?:since|founded(?: in)?|established(?: in)?|est\.?|in business since|opened (?:our doors )?in)"
    r"\s+(1[89]\d{2}|20[0-2]\d)\b"
)
YEARS_PATTERN = r"\b(?:for|over|more than|nearly|almost)\s+(\d{1,3})\+?\s+years\b"
FOUNDED_MIN_YEAR = 1850
YEARS_RANGE = (3, 150)
COPYRIGHT_PATTERN = r"(?:©|&copy;|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"
COPYRIGHT_MIN_YEAR = 1995
PERSON_NAME = r"([A-Z][a-z]+(?:\s[A-Z]\.)?\s[A-Z][a-zA-Z'\-]{1,20})"
OWNER_ROLES = r"(?i:owner|founder|co-founder|president|ceo|proprietor)"
OWNER_NAME_FIRST = PERSON_NAME + r",?\s+(?:is\s+)?(?:the\s+)?(?:(?i:our)\s+)?" + OWNER_ROLES + r"\b"
OWNER_ROLE_FIRST = OWNER_ROLES + r"\s*(?:[,:\-–]|and)?\s+" + PERSON_NAME
NOT_A_FIRST_NAME = [
    "Our", "The", "Contact", "About", "Call", "Read", "Meet", "Learn", "Home", "Service",
    "Services", "Get", "Free", "Request", "Book", "Customer", "Company", "Business",
]
HEADCOUNT_PATTERN = (
    r"\b(?:team of|staff of|over|more than|nearly)\s+(\d{1,4})\s+"
    r"(?:employees|technicians|team members|professionals|staff|people)\b"
)
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
EMAIL_IMAGE_SUFFIXES = [".png", ".jpg", ".gif", ".webp", ".svg"]
EMAIL_IGNORED_HOSTS = ["sentry.io", "wixpress.com", "example.com", "domain.com", "email.com", "yourdomain.com"]
PHONE_PATTERN = r"(?:\+?1[\s.-]?)?\(?([2-9]\d{2})\)?[\s.-]?(\d{3})[\s.-](\d{4})\b"
SOCIAL_NETWORKS = ["linkedin", "facebook", "instagram"]
CMS_MARKERS = {
    "WordPress": "wp-content", "Wix": "wixstatic", "Squarespace": "squarespace",
    "Shopify": "cdn.shopify", "GoDaddy Builder": "wsimg.com", "Weebly": "weebly",
}
TECH_PATTERNS = {
    "online_booking": r"calendly|servicetitan|housecallpro|acuityscheduling|book online|schedule online",
    "live_chat": r"intercom|drift\.com|tawk\.to|livechatinc|podium",
    "analytics": r"googletagmanager|google-analytics|gtag\(",
    "marketing_automation": r"hs-scripts|mailchimp|klaviyo|activecampaign",
}
DIGITAL_POINTS = {
    "https": 15, "mobile_friendly": 20, "fresh": 20, "online_booking": 15,
    "live_chat": 10, "analytics": 10, "marketing_automation": 10,
}
EMAILS_KEPT, PHONES_KEPT, TERMS_KEPT = 8, 4, 6
SNIPPET_PAD = 70
DESCRIPTION_TEXT_CHARS, DESCRIPTION_MAX_CHARS, TITLE_QUOTE_CHARS = 220, 300, 120
INDUSTRY_PAGES, INDUSTRY_MIN_HITS = 3, 2

# --- fixed values: scoring ---
DEFAULT_ICP = {
    "target_industries": [
        "HVAC", "Plumbing", "Electrical", "Roofing", "Landscaping", "Pest control",
        "Commercial cleaning", "Accounting", "IT services", "Manufacturing", "Logistics",
    ],
    "employees_min": 5,
    "employees_max": 150,
    "min_years": 10,
    "weights": {
        "maturity": 20, "size": 15, "industry": 15, "recurring": 15,
        "succession": 15, "upside": 10, "reachability": 10,
    },
}
COMPONENT_LABELS = {
    "maturity": "Years in business", "size": "Company size", "industry": "Industry fit",
    "recurring": "Recurring revenue", "succession": "Owner transition", "upside": "Digital upside",
    "reachability": "Owner reachable",
}
COMPONENT_GROUPS = {
    "maturity": "business", "size": "business", "industry": "business",
    "recurring": "opportunity", "succession": "opportunity", "upside": "opportunity",
    "reachability": "access",
}
GROUP_LABELS = {
    "business": "Is it a solid business?",
    "opportunity": "Is there an opportunity?",
    "access": "Can you reach the owner?",
}
TIER_FLOORS = {"A": 72, "B": 55, "C": 38}
TIER_LABELS = {"A": "Strong fit", "B": "Good fit", "C": "Weak fit", "D": "Poor fit"}
DEDUCTIONS = {"pe_backed": 25, "franchise": 15}

# --- fixed values: workflow and display labels ---
STATUSES = ["pending", "enriched", "failed"]
STAGES = ["new", "shortlist", "contacted", "passed"]
NOTES_MAX_CHARS = 5000
EMAIL_STATUS_LABELS = {
    "valid": ("Direct email", "good"),
    "personal_domain": ("Personal email", "good"),
    "role": ("General inbox", "watch"),
    "unverified": ("Unverified", "watch"),
    "invalid": ("Invalid email", "risk"),
}
EVIDENCE_LABELS = {
    "founded_year": "Founding year", "owner_name": "Owner", "succession": "Owner transition",
    "family_owned": "Family business", "recurring_revenue": "Recurring revenue", "hiring": "Hiring",
    "franchise": "Franchise", "pe_backed": "Existing investor",
}
PAGE_LABELS = {
    "home": "Home page", "about": "About page", "services": "Services page",
    "contact": "Contact page", "careers": "Careers page",
}
CRM_COLUMNS = [
    "Company name", "Company Domain Name", "First Name", "Last Name", "Email", "Phone Number",
    "City", "State/Region", "Industry", "Number of Employees", "Year Founded",
    "Acquisition Fit Score", "Fit Tier", "Data Confidence", "Email Status", "Why It Fits",
    "Risks", "Pipeline Stage", "Notes",
]
BRIEF_KEYS = ["summary", "why_it_fits", "risks", "questions", "email_subject", "email_body"]
