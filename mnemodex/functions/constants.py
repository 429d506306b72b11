"""Values that results depend on."""

# ranking
RRF_K = 60
LEXICAL_WEIGHT = 0.03
TAG_WEIGHT, TYPE_WEIGHT = 0.002, 0.00067
DEFAULT_LIMIT, DEFAULT_CANDIDATES, MAX_LIMIT = 5, 100, 100
NEIGHBOUR_LIMIT, CONFLICT_SIMILARITY = 5, 0.90
BM25_K1, BM25_B, BM25_MIN_IDF = 1.2, 0.75, 1e-6
# Tags and listings
TAG_COMMON_SHARE, TAG_ADVICE_MIN_RECORDS = 0.25, 30
RECORD_PAGE, RECORD_PAGE_MAX, SESSION_PAGE = 20, 200, 100
VOCABULARY_LIMIT, VOCABULARY_SURFACE = 64, 40
# storage
CHUNK_TARGET_BYTES = 262_144
COMPACT_RATIO, MIN_COMPACT_BYTES = 0.25, 65_536
IDLE_SECONDS, MAX_AGE_SECONDS, CLAIM_SECONDS, MAX_RECORDS = 300, 3600, 600, 100_000
SLAB_BYTES = 10 * 4 * 1024 * 1024
REPACK_WATERMARK = 0.75
# records
STATEMENT_MAX = CONTEXT_MAX = 8192
TAGS_MAX, TAG_BYTES_MAX = 32, 64
TITLE_MAX, SUMMARY_MAX = 512, 16_384
MESSAGE_ID_MAX, PARTS_MAX = 256, 1024
SNIPPET_BYTES, TITLE_RUNES = 320, 72
RESUME_TURNS, RESUME_MAX, RESUME_CHOICES = 30, 100, 15
MODEL_DIM = 384
TYPES = ("fact", "preference", "insight", "doc", "profile", "correction")
ROLES = ("user", "assistant", "system", "tool")
KINDS = ("memory", "session", "chunk")
MESSAGE_SCHEMA = "mnemodex/v1"
SESSION_KINDS = ("main", "subagent", "background")
#: Worst last.
ORIGINS = ("chunk", "derived", "observed", "reverse", "synthesised", "lost")
# Words that lexical analysis drops
STOPWORDS = (
    "the and for are but not you all can her was one our out his has had how its who did yes that this with from they "
    "have were been what when will would there their which about into than them then does doing just some such only very "
    "also any get got let say she him why use used"
).split(" ")
