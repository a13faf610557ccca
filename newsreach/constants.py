"""Fixed values.

Published thresholds, word lists and formats. They must stay as they are for results to agree
with the published analysis; everything here is a default that callers may override.
"""

# Corpus selection
SINCE = "2023-01-01"
PER_STRATUM = 25

# Regional lift at which an outlet counts as regional
LIFT_MIN = 5

# Body text: characters read from the HTML, characters kept after cleaning
BODY_RAW_CHARS = 2500
BODY_TEXT_CHARS = 1000

# Columns that make up the embedded text of a corpus row, in this order
TEXT_COLUMNS = ("title", "subtitle", "body_head")
EMBED_BATCH = 200
EMBEDDING_DIMENSIONS = 256

# Additive bonuses of the similarity search
SAME_CATEGORY_BONUS = 0.04
SAME_PLACE_BONUS = 0.04
REACH_BONUS = 0.05
SEARCH_TOP_K = 8
NEIGHBORS = 20

# Re-ranking: bonus per open field, and how many times top_k is fetched first
SPARSE_BONUS = 0.02
FETCH_MULTIPLIER = 3

# Distinctive outlets
OUTLETS_PER_CASE = 4
OUTLETS_OVERALL = 6
UBIQUITOUS_RATIO = 0.5

# Weight of the regional outcome where the place is unknown
DEFAULT_REGIONAL_WEIGHT = 0.77

# Place names: droppable last characters, shortest form that may be matched
PLACE_SUFFIXES = "都府県"
MIN_SHORT_LENGTH = 2

# Titles that announce a physical presence
PRESENCE_KEYWORDS = ("誕生", "オープン", "グランド", "リニューアル", "開設", "店舗", "ショップ", "拠点")

# Legal forms that are not part of a company's bare name
LEGAL_FORMS = ("株式会社", "有限会社", "合同会社", "合資会社", "一般社団法人", "特定非営利活動法人", "学校法人")
MIN_NAME_LENGTH = 2

# Calendar events
NO_TITLE = "(タイトルなし)"
LOCAL_OFFSET = "+09:00"
LOCAL_ZONE = "Asia/Tokyo"
DATE_LENGTH = 10
DESCRIPTION_CHARS = 500
TITLE_CHARS = 255
LOCATION_CHARS = 255
GRID_DAYS = 42

# Draft fields in the order they are asked; fields asked a second time; fields with a causal claim
FIELD_ORDER = ("place", "partner", "people", "novelty", "observation", "video")
RETRY_FIELDS = ("place",)
CAUSAL_FIELDS = ("place",)

# Learning and evaluation
TEST_FRACTION = 0.2
VALID_FRACTION = 0.1
SEED = 7919
MISSING_CATEGORY = 0
GROUP_SIZE = 20
NDCG_K = 10
ENTITY_MIN_ROWS = 10
BOOTSTRAP_ROUNDS = 1000
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0)
FOREST_TREES = 200
FOREST_FEATURES = "0.2"
FOREST_MIN_LEAF = 20
BOOST_STEP = 0.03
BOOST_FEATURES = "0.2"
BOOST_SUBSAMPLE = 0.8
BOOST_MIN_LEAF = 50
BOOST_ROUNDS = 4000
BOOST_PATIENCE = 100

# Effect analysis
MIN_PER_SIDE = 3
MIN_SEGMENT_ROWS = 30
WIN_RATE_MIN = 0.60
RATIO_MIN = 1.15

# Shortest title from which a plan can be rebuilt
MIN_TITLE_LENGTH = 12
