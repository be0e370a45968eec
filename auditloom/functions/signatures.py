"""Signature, keyword and rule tables. All entries are fixed values that results depend on."""

from __future__ import annotations

#: (name, pattern on markup)
CMS = (
    ("WordPress", r"(?i)wp-content|wp-includes"),
    ("Drupal", r"(?i)/sites/default/files"),
    ("TYPO3", r"(?i)/typo3(conf|temp)/"),
    ("Adobe Experience Manager", r"(?i)/etc\.clientlibs/|cq:template"),
    ("Umbraco", r"(?i)/umbraco/"),
    ("Shopify", r"(?i)cdn\.shopify\.com|Shopify\.theme"),
    ("Wix", r"(?i)static\.wixstatic\.com"),
    ("Squarespace", r"(?i)squarespace\.com/universal"),
)
GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']"""
FRAMEWORKS = (
    ("React / Next.js", r"(?i)data-reactroot|__next_data__"),
    ("Angular", r"(?i)ng-version="),
    ("Vue.js / Nuxt", r"(?i)data-v-[a-f0-9]{8}|__nuxt__"),
    ("Svelte", r"(?i)svelte-[a-z0-9]{6}"),
)
#: (pieces of a host, name, category); the first that matches counts
INTEGRATIONS = (
    (("google-analytics.com", "googletagmanager.com"), "Google Analytics / Tag Manager", "Analytics"),
    (("maps.googleapis.com", "maps.google.com"), "Google Maps", "Maps"),
    (("facebook.net", "connect.facebook"), "Meta Pixel", "Marketing"),
    (("hotjar.com",), "Hotjar", "Analytics"),
    (("doubleclick.net",), "Google Ads", "Marketing"),
    (("tiqcdn.com", "tealium"), "Tealium", "Tag Manager"),
    (("awswaf.com",), "AWS WAF", "Security"),
    (("intercom.io", "intercomcdn"), "Intercom", "Chat / Support"),
    (("hs-scripts.com", "hubspot"), "HubSpot", "Marketing"),
    (("cloudflare.com", "cloudflareinsights"), "Cloudflare", "Infrastructure"),
)
#: (feature, pattern on the address)
URL_FEATURES = (
    ("Blog / Articles", r"(?i)/(blog|articles?|insights|news)(/|$)"),
    ("FAQ / Help Center", r"(?i)/(faq|help|support)(/|$)"),
    ("Pricing / Plans", r"(?i)/(pricing|plans)(/|$)"),
    ("Careers / Jobs", r"(?i)/(careers?|jobs)(/|$)"),
    ("E-commerce (cart / checkout)", r"(?i)/(cart|checkout|shop|basket)(/|$)"),
    ("Store/Office Locations", r"(?i)/(locations?|branches|stores?|find-us|near-me)(/|$)"),
)
FEATURE_ORDER = (
    "Site Search", "User Login / Account", "User Registration / Signup", "E-commerce (cart / checkout)", "Newsletter Signup", "Blog / Articles",
    "FAQ / Help Center", "Pricing / Plans", "Careers / Jobs", "Multi-language Support", "Video Content", "Testimonials / Reviews",
    "Downloadable Resources", "Contact Form", "Store/Office Locations", "Live Chat Widget",
)
CHAT_SOURCES = ("intercom.io", "intercomcdn", "drift.com", "zdassets.com", "livechatinc.com", "tawk.to", "hubspot.com/conversations")
REGISTER = r"regist|sign-?up|create-?account"
TESTIMONIAL = r"testimonial|customer review|what our (customers|clients) say"
PURPOSE_FEATURES = (("search", "Site Search"), ("login", "User Login / Account"), ("newsletter", "Newsletter Signup"), ("contact", "Contact Form"))
#: (journey, name, ((stage, name, keywords), ...))
JOURNEYS = (
    ("prospective_customer", "Prospective Customer", (
        ("awareness", "Awareness", ("blog", "article", "insight", "guide", "resource", "news", "learn")),
        ("consideration", "Consideration", ("about", "service", "product", "feature", "solution", "case-study", "case_study", "portfolio", "work")),
        ("decision", "Decision", ("pricing", "plans", "demo", "trial", "quote", "compare", "vs")),
        ("action", "Action / Conversion", ("signup", "sign-up", "register", "checkout", "cart", "book", "apply", "contact", "buy", "shop")),
    )),
    ("job_seeker", "Job Seeker", (
        ("discover_careers", "Discover Careers", ("careers", "jobs", "join-us", "join_us", "work-with-us", "we-are-hiring")),
        ("browse_openings", "Browse Openings", ("position", "opening", "vacancy", "job-listing", "job_listing", "openings")),
        ("apply", "Apply", ("apply", "application", "submit-resume", "submit_resume")),
    )),
    ("existing_customer", "Existing Customer / Support", (
        ("sign_in", "Sign In", ("login", "signin", "sign-in", "account", "my-account", "my_account")),
        ("self_service", "Self-Service Help", ("faq", "help", "docs", "documentation", "knowledge-base", "knowledgebase", "kb")),
        ("contact_support", "Contact Support", ("support", "help-desk", "helpdesk", "ticket", "contact-support")),
    )),
    ("press_investor", "Press / Investor", (
        ("company_info", "Company Info", ("about", "company", "who-we-are", "leadership", "our-team", "our_team")),
        ("news_press", "News & Press", ("press", "media", "newsroom", "press-release", "press_release", "announcement")),
        ("investor_relations", "Investor Relations", ("investor", "investors", "shareholder", "financial-report", "financial_report", "/ir/", "ir-")),
        ("media_contact", "Media Contact", ("media-contact", "media_contact", "press-contact", "press_contact")),
    )),
)
SCHEMA_TYPES = ("Organization", "BreadcrumbList", "Article", "Product", "WebPage", "FAQPage")
SEVERITIES = ("critical", "high", "medium", "low")
AXE_SEVERITY = {"critical": "critical", "serious": "high", "moderate": "medium", "minor": "low"}
PRIORITY = {"critical": "High", "high": "High", "medium": "Medium", "low": "Low"}
#: Work area of a finding in the workbook's plan; others are General.
PLAN_AREA = {"orphan_page": "IA", "broken_page": "IA", "missing_h1": "Accessibility", "missing_title": "Content", "missing_meta_description": "Content", "duplicate_title": "Content", "scale_summary": "Scoping"}
TECH_AND_RISK = ("cms_detected", "js_framework_detected", "mixed_content", "exposed_staging", "pii_without_privacy_link")
COMPONENT_TAGS = ("div", "section", "article", "nav", "header", "footer", "aside", "form", "ul", "table", "dialog", "figure", "button")
BARE_COMPONENTS = ("nav", "form", "table", "dialog", "button", "header", "footer")
STYLE_SENSITIVE = ("button", "nav", "form", "table")
SKELETON_SKIP = ("script", "style", "noscript", "svg")
DOCUMENT_LINK = r"(?i)\.(pdf|docx?|xlsx?|pptx?)(\?|$)"
