"""Default thresholds and limits of the pipeline (fixed values)."""

EMBEDDING_DIM = 1536
MERGE_COSINE = 0.60
PENDING_MERGE = 0.65
CATEGORY_COSINE = 0.35
ANCHOR_WEIGHT_SEED, ANCHOR_WEIGHT_RUNTIME = 0.85, 0.60
SIMILAR_CATEGORY = 0.60
CROSS_PARENT_MIN, CROSS_PARENT_MARGIN = 0.45, 0.10
RRF_K, RRF_TOP = 60, 10
BM25_K1, BM25_B = 1.2, 0.75
MIN_CLUSTER = 3
SPLIT_DELTA, SPLIT_MIN_SIZE, MAX_CLUSTERS_SHOWN = 10, 10, 10
SPLIT_PART, SPLIT_PARTS = 5, 4
MERGE_CATEGORY, MERGE_ROOT = 0.80, 0.70
PAIR_CANDIDATE, PAIRS_PER_CATEGORY = 0.50, 20
STALE_DAYS = 30
REROUTE_MARGIN = 0.10
HALF_LIFE_DAYS = 14.0
BATCH_TOKENS = 2000
FUZZY_MARGIN, SPAN_LOW, SPAN_HIGH = 0.03, 0.6, 1.6
BRIEF_LIMIT, SIDE_LIMIT = 30, 10
DISTINGUISHABLE = 0.70
PER_WINDOW, WITH_COMMENTS, PER_POST = 100, 60, 25
POST_CAP, COMMENT_CAP = 10_000, 5_000
UNCATEGORIZED = 1
EVIDENCE_KEPT = ("direct_complaint", "missing_feature", "broken_experience", "unmet_need")
EVIDENCE_DROPPED = ("joke_meme_sarcasm", "self_promotion_showcase", "praise_only", "thought_leadership", "policy_news_grief_inferred", "abstract_opinion")
RETRY_STATUS = (429, 500, 502, 503, 504)
SITE = "https://reddit.com"
