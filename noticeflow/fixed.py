"""Fixed values.

Everything in this module is data that decides results: word lists, patterns,
labels, sentences and default parameters.  Patterns are stated in the plain
`\\s`, `\\d`, `.` dialect; `noticeflow.functions.text.java` turns one into the
dialect of the JVM.
"""

# --- link discovery -------------------------------------------------------
KEYWORDS = ("recruit", "vacanc", "advert", "job", "post", "notice", "career", "employment")
LINKS_PER_PAGE = 200
NOTIFICATION_HREF_PART = ".pdf"
NOTIFICATION_TEXT_PARTS = ("notice", "advert")
APPLICATION_TEXT_PART = "apply"

# --- URL schemes, as the Python standard library's URL joining has them ----
# relative references of these resolve against the page
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
# the last path segment of these may carry `;parameters`
PARAMETER_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
)

# --- documents ------------------------------------------------------------
PDF_CONTENT_TYPE = "application/pdf"
PDF_SUFFIX = ".pdf"
DEFAULT_FILE_NAME = "document.pdf"
PAGE_MARKER = ("\n--- PAGE ", " ---\n")

# --- field patterns (all case-blind; those with gaps let `.` match newlines)
ADVERT_NUMBER = (
    r"(?:Advt\.?|Advertisement|Notification)\s*(?:No\.?|Number)?\s*[:\-]?\s*"
    r"([A-Za-z0-9./()_-]{3,40})"
)
VACANCIES = r"(\d[\d,]*)\s+(?:vacancies|posts|positions)"
DATE = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
DATE_GAP = r".{0,100}?"
START_LABELS = (
    r"application(?:s)?\s+(?:will\s+)?start",
    r"online\s+application(?:s)?\s+(?:will\s+)?start",
)
END_LABELS = (
    r"last\s+date",
    r"closing\s+date",
    r"application(?:s)?\s+(?:close|end)",
)
SNIPPETS = {
    "age_limit": (r"(?:age\s+limit|maximum\s+age).{0,100}", 500),
    "qualification": (
        r"(?:educational\s+qualification|essential\s+qualification|qualification).{0,1200}",
        1500,
    ),
    "experience": (r"(?:experience|work\s+experience).{0,1200}", 1500),
    "application_fee": (r"(?:application\s+fee|fee\s+for\s+application).{0,500}", 700),
}
CONFIDENCE = 0.45

# --- structured overlay ---------------------------------------------------
REQUEST_INSTRUCTION = (
    "Extract only facts explicitly present in this Indian government recruitment notification. "
    "Never invent values. Return JSON matching the schema."
)
REQUEST_CANDIDATE_HEAD = "\nDISCOVERY:\n"
REQUEST_DOCUMENT_HEAD = "\nDOCUMENT:\n"
REQUEST_MAX_CHARS = 120000

# --- default registry and trust rules ------------------------------------
SOURCES = (
    ("Employment News", "https://employmentnews.gov.in/newemp/home.aspx",
     "employment_news", ("employmentnews.gov.in",)),
    ("UPSC Recruitment Advertisements",
     "https://www.upsc.gov.in/recruitment/recruitment-advertisement", "upsc", ("upsc.gov.in",)),
    ("SSC", "https://ssc.gov.in/", "ssc", ("ssc.gov.in",)),
    ("NCS Government Jobs", "https://www.ncs.gov.in/government-jobs", "ncs", ("ncs.gov.in",)),
)
TRUSTED_SUFFIXES = (".gov.in", ".nic.in")
TRUSTED_DOMAINS = ("upsc.gov.in", "ssc.gov.in", "ncs.gov.in", "employmentnews.gov.in")
LOOKBACK_HOURS = 24

# --- report ---------------------------------------------------------------
BLANK_CELL = "—"
NOT_STATED = "Not stated"
VERIFIED, UNVERIFIED = "VERIFIED", "UNVERIFIED"
DEFAULT_HEADING = "Recruitment Notice"
VERIFIED_TEXT = "Official government domain verified."
UNVERIFIED_TEXT = "Could not verify official government domain."
APPLICATION_LINK_TEXT = "Apply Online"
NOTIFICATION_LINK_TEXT = "View Notification"
# label and stored column, in report order; pay, links, verification and
# confidence are computed and carry a name that is no stored column
DETAIL_LABELS = (
    ("Organisation", "organisation"),
    ("Ministry / Department", "ministry_department"),
    ("Post", "post_title"),
    ("Vacancies", "vacancies_total"),
    ("Advertisement number", "advertisement_number"),
    ("Notification number", "notification_number"),
    ("Published / updated", "publication_date"),
    ("Application period", "application_start_date"),
    ("Application closing date", "application_end_date"),
    ("Eligibility", "qualification"),
    ("Experience", "experience"),
    ("Age limit", "age_limit"),
    ("Age relaxation", "age_relaxation"),
    ("Pay", "#pay"),
    ("Application fee", "application_fee"),
    ("Selection process", "selection_process"),
    ("Job location", "job_location"),
    ("Application website", "#application_link"),
    ("Official notification", "#notification_link"),
    ("Source verification", "#verification"),
    ("Extraction confidence", "#confidence"),
)

# --- record: its columns in order, with their types -------------------------
RECORD_FIELDS = (
    ("organisation", "string"),
    ("ministry_department", "string"),
    ("recruiting_body", "string"),
    ("post_title", "string"),
    ("vacancies_total", "bigint"),
    ("advertisement_number", "string"),
    ("notification_number", "string"),
    ("publication_date", "date"),
    ("updated_date", "date"),
    ("application_start_date", "date"),
    ("application_end_date", "date"),
    ("qualification", "string"),
    ("experience", "string"),
    ("age_limit", "string"),
    ("age_relaxation", "string"),
    ("pay_scale", "string"),
    ("pay_level", "string"),
    ("salary", "string"),
    ("category_requirements", "string"),
    ("application_fee", "string"),
    ("application_url", "string"),
    ("notification_url", "string"),
    ("official_source_url", "string"),
    ("official_domain", "string"),
    ("important_instructions", "array<string>"),
    ("selection_process", "string"),
    ("job_location", "string"),
    ("source_name", "string"),
    ("source_verified", "boolean"),
    ("extraction_confidence", "double"),
    ("fingerprint", "string"),
    ("document_hash", "string"),
    ("source_document", "string"),
    ("notes", "string"),
)
