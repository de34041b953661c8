"""The patterns of citations in running text, in the order in which they claim spans, and what is no citation.

Plain text throughout, since results depend on every one of them. The kind is numeric where a number stands for the
reference. Styles whose patterns are equal are kept, as they tell which styles a marker may belong to.
"""

# ruff: noqa: E501

UPPER = r"[A-ZÀ-ÝĂÂĐÊÔƠƯĨŨẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ]"
NOT_A_NAME = (
    r"(?!(?:Theo|Trong|Tại|Với|Như|Của|Bởi|Qua|Từ|Khi|Nếu|Vì|Do|Ở|Hoặc|Và|In|For|By|From|See|As|With|According|However|Although|Similarly|Conversely"
    r"|Specifically|Furthermore|Moreover|Notably|Importantly|Additionally|Meanwhile|Consequently|Nevertheless|Nonetheless|Therefore|Thus|Hence|Indeed|Instead"
    r"|Likewise|Otherwise|Subsequently|Accordingly|Alternatively|Finally|Overall|Recently|Traditionally|Historically|Yet|Still|Even|While|Whereas|Because"
    r"|Since|When|Where|If|Unless|Until|After|Before|Once|Despite|Unlike|Like|Table|Figure|Chapter|Section|Appendix|Part|Page|Papers|Networks)(?:,|\s+))"
)
AUTHOR = rf"(?:(?:van|de|der|von)\s+)*{UPPER}[a-zA-ZÀ-ỹ'’\-]+"
BODY = (
    r"(?:Bộ|Tổng\s+cục|Ủy\s+ban|Uỷ\s+ban|Ngân\s+hàng\s+Nhà\s+nước|Tổ\s+chức|Hiệp\s+hội)(?:\s+[A-Za-zÀ-ỹ&]+){1,8}"
    r"|(?:Chính\s+phủ|Quốc\s+hội|Hiến\s+pháp)(?:\s+[A-Za-zÀ-ỹ&]+){0,6}"
    r"|(?:Bộ\s+luật|Luật|Pháp\s+lệnh)(?:\s+[A-Za-zÀ-ỹ]+){1,6}"
    r"|(?:Nghị\s+định|Thông\s+tư(?:\s+liên\s+tịch)?|Quyết\s+định|Nghị\s+quyết|Chỉ\s+thị)(?:\s+số)?\s+\d+[A-Za-zĐđ0-9/\-]+"
    rf"|(?:Department|Ministry|World\s+Health\s+Organization|United\s+Nations|Reserve\s+Bank)(?:\s+(?:of|for|and|the|&|{UPPER}[a-zA-ZÀ-ỹ\-]*)){{1,8}}"
    r"|(?:Media\s+Helping\s+Media|Amen\s+Clinics|OpenRocket\s+Project|RocketPy\s+Team|RocketSerializer\s+Developers|Pew\s+Research\s+Center|Security\s+Risk\s+Advisors|Microsoft\s+Security|American\s+Library\s+Association|National\s+News\s+Literacy\s+Project|Local\s+News\s+Initiative|IBM|MITRE|Fortinet)"
)
YEAR = r"(?:18|19|20)\d{2}[a-z]?|n\.?\s*d\.?(?:-[a-z])?"
PAGES = r"(?:\s*,\s*(?:(?:dẫn\s+theo|trích\s+dẫn\s+(?:trong|từ)|as\s+cited\s+in|cited\s+in)\s+[^)\]]+|(?:pp?\.?|tr\.?|trang)\s*\d+(?:\s*[-–]\s*\d+)?))?"
SUPERSCRIPT = r"(?:(?<=^)|(?<=[A-Za-zÀ-ÿ]{2})|(?<=[A-Za-zÀ-ÿ]{2}[.,;:\])]))\^(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)"
PAGE_AFTER = r"(?:\s*[:,]\s*(?:pp?\.?\s*)?(\d+(?:[-–]\d+)?|[ivxlcdm]+|n\.?\s*p\.?)(?:\s*[;,]\s*[^)]*)?)?"
TWO_NAMES = r"[A-Z][a-zA-ZÀ-žÀ-ž]+(?:\s+(?:and|&)\s+[A-Z][a-zA-ZÀ-žÀ-ž]+)?(?:\s+et\s+al\.?)?"
NAME_YEAR = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ'-]+(?:\s+(?:and|&|và)\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ'-]+|\s+et\s+al\.?)?"
NOT_BEFORE_YEAR = (
    r"(?!(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|"
    r"Spring|Summer|Fall|Autumn|Winter|In|From|Since|Until|Before|After|During|Between|Around|Circa|See|Table|Figure|Fig|Section|Chapter|Part|Page|Vol|No)\b)"
)
NOT_BEFORE_YEAR_CHICAGO = r"(?!(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december|spring|summer|fall|autumn|winter|in|since|from|until|before|after|circa|ca|table|figure|fig|section|chapter|part|version|ver|vol|no|issue)\b)"
NOT_BEFORE_PAGE = (
    r"(?!(?:Table|Figure|Fig|Section|Chapter|Part|Page|Eq|Equation|Appendix|Stage|Step|Phase|Round|Cycle|Iteration|Pass|Tier|Split|Cluster|Topic|Task|"
    r"Level|Grade|Group|Type|Class|Model|Case|Test|Rule|Item|Point|Edge|Head|Prompt|Query|Sample|User|Comment|Label|Draft|Scheme|Chart|Compound|Reaction|"
    r"Pathway|Experiment|Theorem|Lemma|Proposition|Corollary|Definition|Example|Algorithm|Listing|Supplement|Note|Clause|Scope|"
    r"Line|Row|Col|Column|Version|Ver|Vol|No|Issue|Series|Set|Run|Trial|Block|Layer|Node|Fold|Epoch|Batch|Seed|Score|Rank|Rate|Ratio|Index|Value|Limit|"
    r"Code|Error|Port|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)s?\b)"
)
SURNAME = r"[A-ZÀ-Ý][a-zA-Zà-ÿ'’]{2,}"

#: (name, kind, pattern)
PATTERNS = (
    ("apa_intext_parenthetical", "in_text", rf"[\(\[]([^)\]\[]+),[\"”’']?\s*({YEAR}){PAGES}[\)\]]"),
    ("apa_intext_narrative", "in_text", rf"({BODY}|{NOT_A_NAME}{AUTHOR}(?:(?:\s*,\s*(?:và|and|&)\s+|\s+(?:và|and|&)\s+|\s*,\s*){NOT_A_NAME}{AUTHOR})*(?:\s*,?\s*(?:et\s+a?l\.?|và\s+cộng\s+sự|và\s+cs\.?))?(?:[\s,]{UPPER}[a-zA-ZÀ-ỹ'’\-]*)*)\s+[\(\[]({YEAR}){PAGES}[\)\]]|({NOT_A_NAME}{AUTHOR}\s+et\s+al\.)\s+((?:18|19|20)\d{{2}}[a-z]?)\b"),
    ("ieee_numeric", "numeric", r"\[([1-9]\d{0,2}(?:[,\s\-–—]+[1-9]\d{0,2})*)\]"),
    ("acm_numeric_range", "numeric", r"\[(\d+(?:[,\s\-–]+\d+)*)\]"),
    ("acm_numeric_comma", "numeric", r"\[(\d+(?:[,\s]+\d+)*)\]"),
    ("acm_numeric", "numeric", r"\[(\d+)\]"),
    ("harvard_parenthetical_comma", "in_text", rf"\(([^)]+),\s*(\d{{4}}[a-z]?){PAGE_AFTER}\)"),
    ("harvard_parenthetical", "in_text", rf"\({NOT_BEFORE_YEAR}({NAME_YEAR})\s+((?:18|19|20)\d{{2}}[a-z]?){PAGE_AFTER}\)"),
    ("harvard_narrative", "in_text", rf"({TWO_NAMES})\s+\((\d{{4}}[a-z]?){PAGE_AFTER}\)"),
    ("vancouver_numeric", "numeric", r"\[(\d+(?:[,\s\-]+\d+)*)\]"),
    ("vancouver_parenthetical", "in_text", r"\(([^)]+),\s*(\d{4}[a-z]?)\)"),
    ("vancouver_narrative", "in_text", r"([A-Z][a-zA-ZÀ-žÀ-ž]+(?:\s+et\s+al\.?)?(?:[\s,][A-Z][a-zA-ZÀ-žÀ-ž]*)*)\s+\((\d{4}[a-z]?)\)"),
    ("nature_superscript", "numeric", SUPERSCRIPT),
    ("nature_bracketed", "numeric", r"\[(\d+)\]"),
    ("nature_superscript_comma", "numeric", r"(?:(?<=^)|(?<=[A-Za-zÀ-ÿ]{2})|(?<=[A-Za-zÀ-ÿ]{2}[.,;:\])]))\^(\d+(?:,\s*\^*\d+)+)"),
    ("cse_superscript", "numeric", SUPERSCRIPT),
    ("cse_bracketed", "numeric", r"\[(\d+)\]"),
    ("cse_nameyear_parenthetical", "in_text", r"\(([^)]+),\s*(\d{4}[a-z]?)\)"),
    ("cse_nameyear_parenthetical_nocomma", "in_text", rf"\({NOT_BEFORE_YEAR}({NAME_YEAR})\s+((?:19|20)\d{{2}}[a-z]?)\)"),
    ("acs_superscript", "numeric", SUPERSCRIPT),
    ("acs_author_superscript", "numeric", r"([A-Z][a-zA-ZÀ-žÀ-ž]+)\^(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)"),
    ("ama_superscript", "numeric", SUPERSCRIPT),
    ("ama_bracketed", "numeric", r"\[(\d+)\]"),
    ("chicago_ad_parenthetical", "in_text", rf"\(([^)]+),\s*(\d{{4}}[a-z]?){PAGE_AFTER}\)"),
    ("chicago_ad_parenthetical_nocomma", "in_text", rf"\({NOT_BEFORE_YEAR_CHICAGO}([A-ZÀ-Ý][a-zA-ZÀ-ÿ'.\-]+(?:\s+(?:and|&|và)\s+[A-ZÀ-Ý][a-zA-ZÀ-ÿ'.\-]+|\s+et\s+al\.?)?)\s+((?:18|19|20)\d{{2}}[a-z]?){PAGE_AFTER}\)"),
    ("chicago_ad_narrative", "in_text", rf"({TWO_NAMES})\s+\((\d{{4}}[a-z]?){PAGE_AFTER}\)"),
    ("chicago_notes_superscript", "numeric", r"(?:(?<=^)|(?<=[A-Za-zÀ-ÿ]{2})|(?<=[A-Za-zÀ-ÿ]{2}[.,;:\])\"”]))\^(\d{1,3}(?:[,-]\d{1,3})*)\b"),
    ("chicago_notes_bracketed", "numeric", r"\[(\d+)\]"),
    ("mla_intext_parenthetical_page", "in_text", rf"\({NOT_BEFORE_PAGE}(?:({SURNAME}(?:\s+(?:III|II|IV|Jr\.?|Sr\.?))?(?:\s+(?:and|&|và)\s+{SURNAME}|\s+et\s+al\.)?)(?:\s*,\s*pp?\.\s*|\s+)(?!(?:19|20)\d{{2}}\b)(\d{{1,4}}(?:[-–]\d{{1,4}})?(?:,\s*\d{{1,4}}(?:[-–]\d{{1,4}})?)*|(?!(?:LM|ML|DL|CV|ID|IC|VM|VL|IL|LC|DM|LD)\b)[IVXLCDM]{{1,7}})|{SURNAME}\s+et\s+al\.(?:\s*;\s*{SURNAME}\s+et\s+al\.)*)\)"),
    ("mla_intext_narrative", "in_text", rf"({TWO_NAMES})\s+\(pp?\.\s*(\d+(?:[-–]\d+)?)\)"),
    ("numeric_bracketed", "numeric", r"\[(\d+(?:[,\s\-]+\d+)*)\]"),
    ("numeric_parenthesized", "numeric", r"\((\d+(?:[,\s\-]+\d+)*)\)"),
    ("doi", "doi", r"10\.\d{4,9}/(?:[^\s\]\)\,;()]|\([^\s\]\)\,;()]*\))+"),
    ("url", "url", r"https?://[^\s\]\)\,;]+"),
)

#: A span longer than this is none.
LONGEST = 150
BARE_YEAR = r"^\d{4}[a-z]?$"
NOT_AN_INDEX = r"\[\s*(?:0|(?:18|19|20)\d{2})\s*\]$|^\[\s*0"
PLACEHOLDER = r"(?i)^\(?\s*authors?\b"
TITLE = r"(?i)(?:this\s+essay|comprehensive\s+survey|comprehensive\s+review|introduction\s+to\s+|abstract\s+|survey\s*$|:?\s*survey\s+of\s+|a\s+(?:brief\s+)?(?:survey|review|introduction)|^\s*(?:deep\s+learning|natural\s+language\s+processing))"
SCENARIO = r"(?i)(?:^|\s)Reference:\s*\[\d+\]|(?:^|\s)In-text:\s*\(|(?:^|\s)Expected(?:Mapping|Label):|(?:^|\s)Scenario:|(?:^|\s)APA\d+:|(?:^|\s)IEEE\d+:"
SCENARIO_LINE = r"(?i)^\s*(APA-\d+|IEEE-\d+):"
SCENARIO_BEFORE = r"(?i)(?:In-text|Reference)\s*:"
TEMPLATE = r"\bAuthor,\s*A\.|\bA\.\s*Author\b|\bIn-text\s+marker\s+form\b"
PUBLISHER_BLOCK = r"^[A-Z][a-zA-Z.]+(?:\s+[A-Z][a-zA-Z.]+){0,2}(?:,\s*[A-Z]{2,3})?:\s+[^():]+,\s*(?:17|18|19|20)\d{2}$"
RECEIVED = r"(?i)^(?:received|revised|accepted|published|submitted|ngày\s+nhận|ngày\s+duyệt|ngày\s+đăng)\b"
NUMBERED_THING = (
    r"(?i)^(?:years?|ages?|grades?|phases?|steps?|stages?|rounds?|cycles?|iterations?|passes?|tiers?|splits?|clusters?|topics?|tasks?|items?|points?|nodes?|edges?|blocks?|heads?|prompts?|queries|query|samples?|users?|comments?|labels?|versions?|drafts?|folds?|epochs?|batches?|layers?|seeds?|scores?|ranks?|rates?|ratios?|indices|index|values?|limits?|codes?|errors?|ports?|weeks?|months?|days?"
    r"|chapters?|subchapters?|sections?|scopes?|parts?|clauses?|tables?|figures?|figs?\.?|schemes?|charts?|entries|entry|runs?|compounds?|reactions?|pathways?|models?|equations?|eqs?\.?|experiments?|trials?|cases?|groups?|types?|classes|levels?|rules?|theorems?|lemmas?|propositions?|corollaries|definitions?|examples?|algorithms?|listings?|appendices|appendix|supplements?|notes?|acts|genesis|exodus|psalms?|matthew|mark|luke|john|romans|corinthians)\s+\d"
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SEASONS = ("spring", "summer", "fall", "autumn", "winter")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
HOW_TO_CITE = r"(?i)(?:trích\s+dẫn(?:\s+bài\s+viết)?|cách\s+trích\s+dẫn|how\s+to\s+cite|to\s+cite\s+this|suggested\s+citation|cite\s+this\s+article)\s*:"
ACRONYMS = r"^(?:[A-Z]{2,5}\s+and\s+[A-Z]{2,5},\s+)"
THING_BEFORE_YEAR = r"(?i)^(?:Networks?|Papers?|Tables?|Figures?|Chapters?|Sections?|Parts?|Equations?|Models?|Systems?)\s+\("
FOUNDING_YEAR = r"[\(\[]\s*(?:1[0-7]\d{2})\s*[\)\]]$"
SOME_YEAR = r"(?i)\b(?:(?:18|19|20)\d{2}[a-z]?|n\.?\s*d\.?(?:-[a-z])?)"
LEAD_IN = r"(?i)^(?:see\s+also|see|cf\.?|e\.g\.?,?|i\.e\.?,?|for\s+example|adapted\s+from|modified\s+from|data\s+from|source\s*:)\s+"
PARTICLE = r"^(?:da|de|del|della|der|di|do|dos|du|el|la|le|van|von|zu|zur)\s+[A-ZÀ-Ý]"
