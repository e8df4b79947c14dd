"""Default parameters.

Every size, pattern and word list the engine needs lives here so callers can
override it per call.  Values under "fixed values" must stay as written for
results to agree with the behaviour being reproduced.
"""

from __future__ import annotations


# --------------------------------------------------------------------------
# fixed values
# --------------------------------------------------------------------------

# Fixed chunk length, in code points.
CHUNK_LENGTH = 512
# Separator placed between a chunk and its source URL.
URL_SEPARATOR = "\nURL: "
# Recursive splitter: size, overlap and separators, tried in this order.
SPLIT_SIZE = 4000
SPLIT_OVERLAP = 200
SPLIT_SEPARATORS = ("\n\n", "\n", " ", "")
# Retriever top-k and the k of the plain nearest-neighbour search.
RETRIEVER_K = 4
SEARCH_K = 1
# Row budget of the whole-day backfill (older driver used 100).
BACKFILL_BUDGET = 10
# Sentences kept by the extractive summary.
SUMMARY_SENTENCES = 10
# LSA: smoothing of term frequency.
LSA_SMOOTH = 0.4
# Separator used when retrieved chunks are stuffed into one context string.
CONTEXT_SEPARATOR = "\n\n"
# Separator between few-shot examples and the suffix.
FEWSHOT_SEPARATOR = "\n\n"
# Chat commands (matched on the lower-cased message, first match wins).
CMD_RESET = "@resetear_sesion"
CMD_HISTORY = "@ver_historial"
CMD_AGENT = "usa el agente para"
# Feedback flags accepted by the feedback sink.
FEEDBACK_FLAGS = ("Incorrecto", "Irrelevante", "Ofensivo")
# Path that replaces the path of a notice link (first gazette) and the
# first path segment written into links of the second gazette.
NOTICE_XML_PATH = "diario_boe/xml.php"
BULLETIN_SEGMENT = "boletines"
# Anchor text and anchor-markup pattern used to find notice links.
LINK_TEXT = "Otros formatos"
LINK_PATTERN = ".*otros formatos.*"
# Day-URL template slots ($anio, $mes, $dia): year unpadded, month and day
# zero-padded to two digits.
DAY_SLOTS = ("anio", "mes", "dia")
# Session tokens: 32 characters from [A-Za-z0-9].
TOKEN_LENGTH = 32
# Only documents fetched with this status carry text.
OK_STATUS = 200
LINK_TEMPLATE = '<a href="{0}" target="_blank" style="color: blue;">{0}</a>'

# Suffixes of the published Spanish Snowball stemmer.
STEM_PRONOUNS = frozenset("me se sela selo selas selos la le lo las les los nos".split())
STEM_GERUNDS = frozenset("iéndo ándo ár ér ír ando iendo ar er ir yendo".split())
# Standard suffixes: region they must lie in, what replaces them, and the
# endings that go as well, each with those that may go before it.
STEM_STANDARD = {
    **dict.fromkeys(
        "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas "
        "amiento amientos imiento imientos".split(),
        ("R2", "", {}),
    ),
    **dict.fromkeys("adora ador ación adoras adores aciones ante antes ancia ancias".split(), ("R2", "", {"ic": ()})),
    **dict.fromkeys("logía logías".split(), ("R2", "log", {})),
    **dict.fromkeys("ución uciones".split(), ("R2", "u", {})),
    **dict.fromkeys("encia encias".split(), ("R2", "ente", {})),
    "amente": ("R1", "", {"iv": ("at",), "os": (), "ic": (), "ad": ()}),
    "mente": ("R2", "", {"ante": (), "able": (), "ible": ()}),
    **dict.fromkeys("idad idades".split(), ("R2", "", {"abil": (), "ic": (), "iv": ()})),
    **dict.fromkeys("iva ivo ivas ivos".split(), ("R2", "", {"at": ()})),
}
STEM_VERB_Y = frozenset("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
STEM_VERB_OTHER = frozenset(
    "en es éis emos "
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré "
    "erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron "
    "ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
)
STEM_RESIDUAL = frozenset("os a o á í ó e é".split())

# --------------------------------------------------------------------------
# own values
# --------------------------------------------------------------------------

# Short Spanish stop-word list for the LSA summary (no stemming).
STOP_WORDS_ES = (
    "a al algo algunas algunos ante antes como con contra cual cuando de del "
    "desde donde durante e el ella ellas ellos en entre era es esa esas ese "
    "eso esos esta estas este esto estos fue fueron ha han hasta hay la las "
    "le les lo los mas me mi mucho muy nada ni no nos o os otra otras otro "
    "otros para pero poco por porque que quien se ser si sin sobre su sus "
    "tambien te tiene todo todos tu un una unas uno unos y ya yo"
).split()

# White space as Python's str.isspace() sees it, spelled out so that Java
# and RE2 (the oracle) agree.  Java's \s is ASCII-only unless (?U) is set
# and RE2's \s is ASCII-only and lacks \v.
WS_CLASS = (
    r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Vectors of one batch of questions hold at most so many bytes.
QUESTION_BYTES = 64 << 20
# The same characters, to trim with.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
