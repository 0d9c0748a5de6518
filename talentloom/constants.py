"""Fixed values that results depend on. Everything else is derived."""

# --- fixed values: dates ------------------------------------------------------
PRESENT_TOKENS = ("present", "nay", "now", "current")
MONTH_PATTERN = r"^(\d{4})(?:[-/.](\d{1,2}))?"

# --- fixed values: whitespace trimmed by a Unicode-aware strip ------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class both java.util.regex and RE2 accept.
WHITESPACE_CLASS = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# --- fixed values: degrees, cities, work modes ----------------------------------
DEGREE_RANKS = {
    "other": 1,
    "high_school": 1,
    "associate": 2,
    "bachelor": 3,
    "master": 4,
    "phd": 5,
}
DEGREE_KEYWORDS = (
    ("phd", ("phd", "doctorate", "doctor of")),
    ("master", ("master", "msc", "mba", "m.sc", "m.eng")),
    ("bachelor", ("bachelor", "bsc", "b.sc", "b.eng", "beng", "undergraduate", "licens")),
    ("associate", ("associate",)),
    ("high_school", ("high school", "secondary", "phổ thông")),
)
DEGREE_NULL_TOKENS = ("", "null", "none", "n/a", "na")
CITY_KEYWORDS = (
    ("Ha Noi", ("ha noi", "hanoi")),
    ("Ho Chi Minh", ("ho chi minh", "hcm", "saigon", "sai gon")),
    ("Da Nang", ("da nang", "danang")),
)
HANOI_ABBREVIATION = "hn"
DEFAULT_CITY = "Ha Noi"
WORK_MODES = ("onsite", "hybrid", "remote")
DEFAULT_WORK_MODE = "onsite"
# Terms of the tagged "Education:" line and the level each stands for.
EDUCATION_TERMS = {
    "thpt": "high_school",
    "trung học phổ thông": "high_school",
    "trung cấp": "associate",
    "cao đẳng": "associate",
    "đại học": "bachelor",
    "cử nhân": "bachelor",
    "bachelor": "bachelor",
    "thạc sĩ": "master",
    "master": "master",
    "tiến sĩ": "phd",
    "phd": "phd",
    "doctor": "phd",
}

# --- fixed values: skill matching -----------------------------------------------
FUZZY_THRESHOLD = 0.85
PREFERRED_WEIGHT = 2
NICE_TO_HAVE_WEIGHT = 1
MUST_HAVE_WEIGHT = 3
CREDENTIAL_SEPARATORS = r"[-–—:,/()]+"
CEFR_RANKS = {"a1": 1, "a2": 2, "b1": 3, "b2": 4, "c1": 5, "c2": 6}
PROFICIENCY_PATTERNS = (
    ("jlpt", r"\bjlpt\s*n\s*([1-5])\b"),
    ("hsk", r"\bhsk\s*([1-9])\b"),
    ("topik", r"\btopik\s*([1-6])\b"),
    ("ielts", r"\bielts\s*([0-9](?:\.[05])?)\b"),
    ("toeic", r"\btoeic\s*([0-9]{2,3})\b"),
    ("toefl", r"\btoefl(?:\s*ibt)?\s*([0-9]{2,3})\b"),
    ("cefr", r"\b([abc][12])\b"),
)
# Entries a job may list as skills although no candidate lists them literally.
GENERIC_SKILLS = (
    "programming", "programming fundamentals", "programming basics",
    "programming knowledge", "coding fundamentals", "basic programming",
    "software development", "software engineering", "computer science",
    "problem solving", "analytical thinking", "analytical skills",
    "critical thinking", "logical thinking", "logical reasoning",
    "communication", "communication skills", "interpersonal skills",
    "teamwork", "team player", "teamworking", "collaboration",
    "self learning", "self study", "self motivated", "self motivation",
    "willingness to learn", "eager to learn", "fast learner", "quick learner",
    "learning ability", "continuous learning", "responsibility",
    "sense of responsibility", "time management", "leadership", "creativity",
    "adaptability", "attention to detail", "work ethic", "proactive",
    "hard working", "detail oriented", "multitasking",
)

# --- fixed values: scoring --------------------------------------------------------
DIMENSIONS = ("semantic", "skills", "experience", "education", "location")
DEFAULT_WEIGHTS = {
    "semantic": 0.30,
    "skills": 0.30,
    "experience": 0.25,
    "education": 0.10,
    "location": 0.05,
}
COSINE_MIN, COSINE_MAX = 0.0, 1.0
NEUTRAL = 0.5
MAX_MINUTES_ONSITE, MAX_MINUTES_OTHER = 45.0, 75.0
BONUS_SKILLS_SHOWN = 8
WEIGHT_SUM_TOLERANCE = 1e-6
CHECK_TOLERANCE = 1e-9

# --- fixed values: report wording ---------------------------------------------------
NO_EXPERIENCE_REQUIRED = "JD không yêu cầu số năm kinh nghiệm cụ thể"
EXPERIENCE_PART = "%s năm kinh nghiệm %s"
SENIORITY_PART = "thâm niên %s năm"
EXPERIENCE_SENTENCE = "CV có %s, JD yêu cầu %s năm"

# --- fixed values: ingest -------------------------------------------------------------
MAX_URLS_PER_BATCH = 50
TRAILING_COMMA = r",(\s*[}\]])"
FILENAME_HEADER = r"(?i)filename\*?=(?:UTF-8'')?[\"']?([^\"';\r\n]+)"
MIN_TEXT_QUALITY = 60
CLOUD_CATEGORIES = ("AWS services", "Azure services", "GCP services")
