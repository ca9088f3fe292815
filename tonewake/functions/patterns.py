"""Patterns of transcripts and their date fields, in Java's syntax with Unicode classes."""

# They decide which lines are headers, which phrases go, and which role a title has.
PREPARED_HEADER = r"(?iU)^Prepared Remarks:$"
QA_HEADER = r"(?iU)^(Questions and Answers:|Questions & Answers:|Question-and-Answer Session|Questions and Answers)$"
SPEAKER_LINE = r"(?U)^([^-\n][^\n]*?) -- (.+)$"
OPERATOR_LINE = r"(?iU)^Operator$"
FOOTER = r"(?iU)^(Duration:\s*\d+|Call participants:|More \w+ analysis|All earnings call transcripts|\[Operator Closing Remarks\])"
BOILERPLATE = (
    r"(?iU)\[Operator Instructions\]",
    r"(?iU)(?:your|the) (?:line is (?:now )?open|phone line is open)",
    r"(?iU)please (?:go ahead|proceed|ask your question)",
    r"(?iU)(?:thank you for (?:standing by|holding|joining)|ladies and gentlemen,? (?:thank you|good (?:morning|afternoon|evening)))",
    r"(?iU)(?:this (?:call|conference|discussion) (?:may |will )?contain[s]? forward-looking statements?[^.]*\.)",
    r"(?iU)(?:intended to qualify for the safe harbor[^.]*\.)",
    r"(?iU)(?:this (?:call|conference) is being recorded[^.]*\.)",
    r"(?iU)(?:a (?:webcast |audio )?replay of this (?:call|conference)[^.]*\.)",
)
CEO = r"(?iU)\b(chief executive officer|co-?ceo|co-?founder.{0,30}ceo|president.{0,40}ceo|ceo.{0,40}president|chairman.{0,40}ceo)\b"
CFO = r"(?iU)\b(chief financial officer|co-?cfo|evp.{0,20}cfo|svp.{0,20}cfo)\b"
INVESTOR_RELATIONS = r"(?iU)\b(investor relations|ir |head of ir|vp.{0,10}ir|director.{0,20}investor|vice president.{0,20}investor)\b"
ANALYST = r"(?iU)\banalyst\b"
DATE = (
    r"(?iU)(Jan(?:uary)?\.?|Feb(?:ruary)?\.?|Mar(?:ch)?\.?|Apr(?:il)?\.?|May\.?|Jun(?:e)?\.?|Jul(?:y)?\.?|Aug(?:ust)?\.?|"
    r"Sep(?:tember)?\.?|Oct(?:ober)?\.?|Nov(?:ember)?\.?|Dec(?:ember)?\.?)\s+\d{1,2},?\s+\d{4}"
)
ZONE_END = r"(?U)\s+E[SD]?T$"
CALL_TIME = r"(?iU)(\d{1,2}):(\d{2})\s+(a\.m\.|p\.m\.)"
EXCHANGE = r"(?U)^(\w+)"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
# The sizes of chunks and sections, the call time that counts as after the close.
CHARS_PER_TOKEN = 4.5
MAX_TOKENS = 512
MIN_PREPARED_LINES = 10
MAX_HEADER_CHARS = 120
MARKET_CLOSE_MINUTES = 16 * 60
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: The characters of EDGES, for trimming without a pattern.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
