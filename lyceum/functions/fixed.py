"""Word lists, patterns and formats that results depend on. They are data, not logic."""

# --- pages ---------------------------------------------------------------------------------------------------------
ADMISSION_KEYWORDS = [
    "admission", "admissions", "enroll", "apply", "application",
    "courses", "eligibility", "qualification", "fees", "hostel",
    "deadline", "dates", "seats", "capacity", "reservation",
]
PLACEMENT_KEYWORDS = [
    "placement", "placements", "career", "careers", "recruit",
    "recruitment", "jobs", "salary", "package", "companies",
    "hiring", "internship", "internships", "company", "placed",
]
ADMISSION_INDICATORS = [
    "admission process", "how to apply", "eligibility criteria",
    "important dates", "application form", "entrance exam",
    "admission schedule", "fee structure", "hostel facility",
    "seat matrix", "reservation policy", "required documents",
]
PLACEMENT_INDICATORS = [
    "placement record", "placement statistics", "recruiting companies",
    "highest package", "average package", "median salary",
    "placement cell", "internship opportunities", "campus recruitment",
    "placement brochure", "placement report", "recruiting partners",
]
ADMISSION_PATHS = [
    r"admission|apply|enroll|courses", r"programs?/[a-z-]+", r"undergraduate|graduate|phd",
    r"fee-structure|hostel-fee|scholarships?", r"seat|capacity|selection|criteria",
]
PLACEMENT_PATHS = [
    r"placement|career|recruit|jobs?", r"training[-_]and[-_]placement", r"campus[-_]placement",
    r"internship|companies|packages?", r"salary|alumni",
]
FILE_TYPES = ["pdf", "doc", "docx", "xls", "xlsx", "csv", "jpg", "jpeg", "png", "gif"]
PAGE_BUDGET = 50
CONTENT_SELECTORS = [
    "main", "article", "#content", ".content", "#main-content", ".main-content", "#main", ".main", ".page-content", "#page-content",
]
IMAGE_INDICATORS = ["chart", "graph", "data", "statistics", "placement", "admission"]

# --- files ---------------------------------------------------------------------------------------------------------
FILE_ADMISSION_WORDS = [
    "admission", "apply", "eligibility", "entrance", "application form", "counselling", "selection", "seat", "course", "fee",
    "hostel",
]
FILE_PLACEMENT_WORDS = [
    "placement", "recruiter", "company", "salary", "package", "career", "internship", "training", "industry", "job",
    "employed", "hire",
]

# --- text ----------------------------------------------------------------------------------------------------------
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: All names of months begin with one of these.
MONTH_STARTS = _SHORT_MONTHS.lower().split("|")
DATE_PATTERNS = [
    r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})",
    rf"({_MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})",
    rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTHS}),?\s+(\d{{4}})",
    rf"(\d{{1,2}})[/.-]({_SHORT_MONTHS})[/.-](\d{{2,4}})",
    rf"({_SHORT_MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})",
]
NUMBER_PATTERNS = [
    r"(?:Rs\.?|INR|₹)\s*(\d+(?:,\d+)*(?:\.\d+)?)", r"(\d+(?:\.\d+)?)%", r"(\d+(?:,\d+)+)", r"(\d+\.\d+)", r"(\d{4,})",
]
PLAIN_NUMBER = r"[-+]?\d*\.\d+|\d+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+91|0)?[6-9]\d{9}"
#: Day before month wherever both readings are valid.
DATE_FORMATS = [
    "yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d.M.yyyy", "M.d.yyyy", "MMMM d, yyyy", "d MMMM, yyyy",
    "d MMM yyyy", "MMM d, yyyy",
]
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
CONTEXT = 100

# --- admission -----------------------------------------------------------------------------------------------------
DEADLINE_PHRASES = [
    "application deadline", "last date", "admission date", "important dates", "admission schedule", "last date to apply",
    "registration deadline",
]
DEADLINE_TYPES = {
    "application": ["application", "apply", "registration", "register", "form"],
    "entrance_exam": ["entrance", "exam", "test"],
    "result_declaration": ["result", "declaration", "announce", "publication"],
    "interview_counselling": ["interview", "counselling", "counseling", "selection"],
    "fee_payment": ["fee", "payment", "deposit"],
    "class_commencement": ["class", "start", "commencement", "begin"],
}
EVENT_HEADERS = ["event", "activity", "particular", "detail"]
COURSE_PHRASES = [
    "courses offered", "available courses", "programs", "specializations", "branches", "disciplines", "degrees",
    "courses available",
]
COURSE_HEADERS = ["course", "program", "degree", "branch"]
COURSE_TABLE_HEADERS = [*COURSE_HEADERS, "discipline"]
DURATION_HEADERS = ["duration", "years", "period"]
COURSE_SEAT_HEADERS = ["seats", "intake", "capacity"]
COURSE_FEE_HEADERS = ["fee", "fees", "tuition"]
SEAT_TOTALS = [
    r"total(?:\s+number\s+of)?\s+seats\s*(?:is|are|:)?\s*(\d+)", r"total\s+intake\s*(?:is|:)?\s*(\d+)",
    r"(?:college|institute)\s+(?:has|with)\s*(\d+)\s+seats",
]
CATEGORY_HEADERS = ["category", "reservation", "quota"]
SEAT_HEADERS = ["seats", "number", "capacity", "count"]
FEE_HEADERS = ["fee", "fees", "tuition", "amount"]
FEE_COURSE_HEADERS = ["course", "program", "branch", "degree"]
_LINES = r"((?:.+?(?:\n|$)){1,%d})"
SCHEDULES = [
    r"payment\s+schedule[:\s]+" + _LINES % 10, r"fee\s+payment\s+schedule[:\s]+" + _LINES % 10,
    r"installment(?:\s+details)?[:\s]+" + _LINES % 10,
]
HOSTELS = [
    r"%s\s+hostel\s+(?:is\s+)?(available|not available)",
    r"hostel\s+(?:facilities\s+)for\s+%s\s+(?:is\s+)?(available|not available)",
    r"(separate|dedicated)\s+hostel\s+for\s+%s",
]
HOSTEL_FEES = [
    r"hostel\s+fee[s]?\s*(?:is|:)?\s*(?:Rs\.?|INR|₹)?\s*(\d+(?:,\d+)*(?:\.\d+)?)",
    r"hostel\s+charges[:\s]*(?:Rs\.?|INR|₹)?\s*(\d+(?:,\d+)*(?:\.\d+)?)",
]
REQUIREMENTS = [
    r"eligibility\s+criteria[:\s]+" + _LINES % 15, r"academic\s+requirements[:\s]+" + _LINES % 15,
    r"minimum\s+qualification[:\s]+" + _LINES % 15,
]
EXAMS = [
    "JEE Main", "JEE Advanced", "GATE", "CAT", "MAT", "NEET", "GMAT", "GRE", "CMAT", "XAT", "CLAT", "NATA", "BITSAT",
]
CUTOFFS = [
    r"%s(?:\s+cut[\-\s]off|\s+score|\s+rank)(?:\s+is|\s*:)?\s*(\d+(?:\.\d+)?)",
    r"minimum\s+%s\s+(?:score|rank|percentile)(?:\s+is|\s*:)?\s*(\d+(?:\.\d+)?)",
]
MINIMUM_PERCENTAGES = [
    r"minimum\s+(?:percentage|marks)(?:\s+required)?\s*(?:is|:)?\s*(\d+(?:\.\d+)?)\s*%",
    r"(?:candidate|student)s?\s+must\s+have\s+(?:secured|obtained|scored)(?:\s+a\s+minimum\s+of)?\s*(\d+(?:\.\d+)?)\s*%",
]
PERCENTAGE_KEY = "12th_percentage"

# --- placement -----------------------------------------------------------------------------------------------------
_AMOUNT, _PLAIN = r"(?:Rs\.?|INR|₹)?\s*(\d+(?:,\d+)*(?:\.\d+)?)", r"(?:Rs\.?|INR|₹)?\s*(\d+(?:\.\d+)?)\s*(?:lakh|lac|lacs)?"
_PAY = r"\s+(?:package|salary|ctc)"
STATISTICS = {
    "avg_package": [rf"average{_PAY}(?:\s+is|\s*:)?\s*{_PLAIN}", rf"average{_PAY}(?:\s+of|\s*:)?\s*{_AMOUNT}"],
    "highest_package": [
        rf"highest{_PAY}(?:\s+is|\s*:)?\s*{_PLAIN}", rf"highest{_PAY}(?:\s+of|\s*:)?\s*{_AMOUNT}",
        rf"maximum{_PAY}(?:\s+is|\s*:)?\s*{_PLAIN}",
    ],
    "median_package": [rf"median{_PAY}(?:\s+is|\s*:)?\s*{_PLAIN}", rf"median{_PAY}(?:\s+of|\s*:)?\s*{_AMOUNT}"],
    "students_placed_count": [
        r"(\d+)\s+students\s+(?:were\s+)?placed", r"number\s+of\s+students\s+placed(?:\s+is|\s*:)?\s*(\d+)",
        r"placed\s+(\d+)\s+students",
    ],
    "total_students": [
        r"total\s+(?:number\s+of\s+)?students(?:\s+is|\s*:)?\s*(\d+)", r"(\d+)\s+students\s+were\s+eligible",
        r"batch\s+(?:strength|size)(?:\s+of|\s+is|\s*:)?\s*(\d+)",
    ],
    "placement_percentage": [
        r"placement\s+percentage(?:\s+is|\s*:)?\s*(\d+(?:\.\d+)?)\s*%",
        r"(\d+(?:\.\d+)?)\s*%\s+(?:students\s+)?(?:were\s+)?placed",
        r"placement\s+rate(?:\s+is|\s*:)?\s*(\d+(?:\.\d+)?)\s*%",
    ],
}
#: Values of 100 and more are divided by this, unless the pattern that found them names lakhs.
LAKH = 100000
STATISTIC_HEADERS = ["package", "salary", "ctc", "placed", "recruitment"]
SUMMARY_ROWS = 3
COMPANY_TOTALS = [
    r"(\d+)\s+companies\s+(?:visited|participated|recruited)",
    r"total\s+(?:number\s+of\s+)?companies(?:\s+visited)?(?:\s+is|\s*:)?\s*(\d+)",
    r"(?:visited|participated|recruited)(?:\s+by)?\s+(\d+)\s+companies",
]
_UNTIL_STOP = r"(?:\s+include)?[:\s]+(.+?)(?:\n\n|\.\s+[A-Z])"
COMPANY_SECTIONS = [
    r"(?:top|major|prominent)\s+recruiters" + _UNTIL_STOP, r"(?:top|major|prominent)\s+companies" + _UNTIL_STOP,
    r"our\s+recruiters" + _UNTIL_STOP,
]
NOISE = ["companies", "include", "etc", "and", "more", "others"]
COMPANY_HEADERS = ["company", "recruiter", "organization", "firm"]
YEAR_HEADERS = ["year", "session", "batch", "academic year"]
YEAR_STATISTIC_HEADERS = ["package", "placed", "salary", "ctc", "recruitment"]
PACKAGE_HEADERS, PERCENTAGE_HEADERS = ["package", "salary", "ctc"], ["percentage", "%"]
YEARS = [r"(20\d\d)(?:[^0-9]|$)", r"(\d\d)[^0-9](\d\d)"]
ALTERNATIVE_PATHS = {
    "higher_studies": [
        r"(\d+(?:\.\d+)?)\s*%\s+(?:students\s+)?(?:went\s+for|opted\s+for|pursuing)\s+higher\s+studies",
        r"higher\s+studies\s*(?::|\s+-)?\s*(\d+(?:\.\d+)?)\s*%",
        r"(\d+)\s+students\s+(?:went\s+for|opted\s+for|pursuing)\s+higher\s+studies",
    ],
    "abroad_studies": [
        r"(\d+(?:\.\d+)?)\s*%\s+(?:students\s+)?(?:went|studying)\s+abroad",
        r"(?:study|studies)\s+abroad\s*(?::|\s+-)?\s*(\d+(?:\.\d+)?)\s*%", r"(\d+)\s+students\s+(?:went|studying)\s+abroad",
    ],
    "startups_founded": [
        r"(\d+(?:\.\d+)?)\s*%\s+(?:students\s+)?founded\s+(?:their\s+own\s+)?(?:startups|companies|ventures)",
        r"(?:startups|ventures|entrepreneurship)\s*(?::|\s+-)?\s*(\d+(?:\.\d+)?)\s*%",
        r"(\d+)\s+students\s+founded\s+(?:their\s+own\s+)?(?:startups|companies|ventures)",
    ],
}
#: Path -> header words; a header counts for the first path whose words it holds.
ALTERNATIVE_HEADERS = {
    "higher_studies": ["higher studies"], "abroad_studies": ["abroad"], "startups_founded": ["startup", "entrepreneur"],
}
ALTERNATIVE_TABLE_HEADERS = ["higher studies", "abroad", "startups", "entrepreneurship"]
INTERNSHIP_COUNTS = [
    r"(\d+)\s+(?:students\s+)?(?:received|got|were\s+offered)\s+internship", r"(?:offered|provided)\s+(\d+)\s+internships",
    r"number\s+of\s+internships(?:\s+is|\s*:)?\s*(\d+)",
]
INTERNSHIP_PERCENTAGES = [
    r"(\d+(?:\.\d+)?)\s*%\s+(?:students\s+)?(?:received|got|were\s+offered)\s+internship",
    r"internship\s+percentage(?:\s+is|\s*:)?\s*(\d+(?:\.\d+)?)\s*%",
]
INTERNSHIP_SECTIONS = [
    r"internship\s+(?:companies|providers|recruiters)" + _UNTIL_STOP,
    r"companies\s+(?:offering|providing)\s+internships?" + _UNTIL_STOP,
]
INTERNSHIP_HEADERS = ["internship", "summer training", "industrial training"]
INTERNSHIP_COMPANY_HEADERS = ["company", "organization", "provider"]
RECRUITMENT_KINDS = {"on_campus": "on", "off_campus": "off", "pool_campus": "pool"}
RECRUITMENT_TYPES = [
    r"(\d+(?:\.\d+)?)\s*%%\s+(?:of\s+)?(?:students\s+)?(?:placed|recruited)\s+through\s+%s[\s-]campus",
    r"%s[\s-]campus\s+placement(?:\s+percentage)?(?:\s+is|\s*:)?\s*(\d+(?:\.\d+)?)\s*%%",
    r"(\d+)\s+students\s+(?:placed|recruited)\s+through\s+%s[\s-]campus",
]
CONFIDENCE = 0.7
