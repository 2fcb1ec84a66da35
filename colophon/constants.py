"""Names, limits, patterns and messages whose exact value decides a result."""

# --- periods of the discovery rollups (name, days back; None = everything) ---------------
PERIODS = (("day", 1), ("week", 7), ("month", 30), ("all", None))
KEYWORD_PERIODS = PERIODS[1:]
ENTITY_TYPES = ("performer", "maker", "series")
POPULARITY_WEIGHT = 0.01
CLICK_WEIGHT = 2

# --- recommendation weights ---------------------------------------------------------------
RECOMMEND_WEIGHTS = {
    "popularity": 2,
    "favorite_count": 3,
    "performer": 100,
    "maker": 40,
    "series": 60,
    "genre": 30,
}

# --- page size limits ---------------------------------------------------------------------
SITEMAP_PAGE_SIZE = 1000
ADMIN_PAGE_SIZE = 30
TEMPLATE_BATCH_MAX = 50_000

# --- name keys: characters removed besides ASCII white space --------------------------------
# ideographic space, hyphen, non-breaking hyphen, figure dash, en dash, em dash,
# horizontal bar, katakana long vowel mark, katakana middle dot, _ / . -
NAME_KEY_DROP = "[\\s　‐‑‒–—―ー・_/.\\-]"

# --- catalog CSV --------------------------------------------------------------------------
CSV_HEADER_NAMES = {
    "品番": "product_code",
    "タイトル": "title",
    "女優名": "performer",
    "女優名かな": "performer_kana",
    "女優名カナ": "performer_kana",
    "メーカー": "maker",
    "シリーズ": "series",
    "シリーズ名": "series",
    "レーベル": "label",
    "ジャンル": "genre",
    "収録時間": "duration",
    "発売日": "release_date",
    "サンプル画像": "sample_images",
    "カード画像url": "card_image_url",
    "サムネ画像url": "image_url",
    "動画url": "video_url",
    "アフィリエイトurl": "affiliate_url",
    "説明": "description",
    "人気度": "popularity",
    "お気に入り数": "favorite_count",
    "タグ": "tags",
    "削除項目": "clear_fields",
    "actress_name": "performer",
    "actress_name_kana": "performer_kana",
    "maker_name": "maker",
    "series_name": "series",
    "label_name": "label",
    "card_thumbnail_url": "card_image_url",
    "thumbnail_url": "image_url",
}
CSV_COLUMNS = (
    "product_code", "title", "performer", "performer_kana", "maker", "series", "label", "genre",
    "tags", "duration", "release_date", "sample_images", "card_image_url", "image_url", "video_url",
    "affiliate_url", "description", "popularity", "favorite_count", "clear_fields",
)
CSV_CLEARABLE = (
    "performer", "maker", "series", "label", "genre", "duration", "release_date", "sample_images",
    "card_image_url", "image_url", "video_url", "affiliate_url", "description", "popularity",
    "favorite_count", "tags",
)
MAX_SAFE_INTEGER = 9007199254740991
CSV_MESSAGES = {
    "code": "品番は必須です。",
    "date": "発売日はYYYY-MM-DD形式です。",
    "number": "数値項目は0以上の整数です。",
    "url": "URL形式が正しくありません。",
    "title": "新規作品ではタイトルが必須です。",
}
CSV_CLEAR_MESSAGE = ("削除項目「", "」は指定できません。")

# --- candidate intake ---------------------------------------------------------------------
ITEM_LENGTH_LIMITS = {
    "source": 50,
    "source_key": 500,
    "source_url": 2000,
    "product_code": 100,
    "title": 1000,
    "performer": 300,
    "maker": 300,
    "series": 500,
}
ITEM_TAG_LIMITS = (100, 100)  # at most 100 tags of at most 100 characters
ITEM_EXPORT_COLUMNS = (
    "source", "source_key", "source_url", "observed_at", "product_code", "title", "performer",
    "maker", "series", "tags", "status",
)
POST_LABELS = {
    "title": ("タイトル", "作品名"),
    "performer": ("女優", "出演"),
    "maker": ("メーカー", "レーベル"),
    "series": ("シリーズ",),
}

# --- code aliases and rejections ------------------------------------------------------------
CODE_ALIASES = {"H_1784FT000062": "H_1784FTO00062", "H_1784FT000064": "H_1784FTO00064"}
REJECTED_CODES = ("1NAMH500006",)
CODE_REJECTION = "REJECTED_AUDIT_CODE"
CODE_REJECTION_REASON = "audit-only product code is not a runtime identity"

# --- review -------------------------------------------------------------------------------
QUALITY_DEFAULTS = {
    "high": 0.90,
    "medium": 0.65,
    "auto_approve": 0.98,
    "auto_approve_enabled": False,
    "min_samples": 200,
    "min_precision": 0.98,
}
PREVIEW_STATES = ("new", "update", "unchanged", "duplicate", "needs_review")
PUBLIC_VISIBILITY = ("public_general", "affiliate_visible", "approved_affiliate_only")
POST_MEDIA_TYPES = ("text", "image", "video", "mixed", "unknown")
LINK_STATES = ("missing", "active", "ineligible", "revoked")

# --- prioritisation -------------------------------------------------------------------------
LANES = ("RECENT_POPULAR", "LATEST", "BACKFILL")
LANE_RATIOS = {"RECENT_POPULAR": 0.60, "LATEST": 0.25}
LANE_SORT = {"RECENT_POPULAR": "rank", "LATEST": "date", "BACKFILL": "backfill"}
POPULAR_MAX_AGE_DAYS = 180
LATEST_PROTECTION_DAYS = 7
AGE_BUCKETS = ("0-7d", "8-30d", "31-90d", "91-180d", "180+d", "UNKNOWN")
FROZEN_CLASSES = (
    "EXISTING_UNCHANGED", "EXISTING_UPDATE", "SAFE_NEW", "NEEDS_REVIEW", "DUPLICATE", "INVALID", "ERROR",
)
MANIFEST_ROWS_MAX = 1000

# --- identifiers ----------------------------------------------------------------------------
UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SESSION_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
LOOSE_ID_PATTERN = "(?i)^[0-9a-f-]{36}$"
SLUG_PATTERN = "^[A-Za-z0-9_.-]{1,64}$"
PRIVATE_KEY_PATTERN = (
    "(?i)(account|address|bank|cookie|credential|email|password|phone|session|sms|token|user_id|affiliate_id)"
)
