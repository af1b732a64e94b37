"""Values that must stay equal to the analysed application's for equal results.

FIXED VALUES -- stated as given, in their natural order.  Do not edit.
"""

# --- fixed values: sentiment label thresholds (both bounds inclusive) -------
POSITIVE_AT_OR_ABOVE = 0.05
NEGATIVE_AT_OR_BELOW = -0.05

# --- fixed values: extra stop words for topics, dashboard variant -----------
DOMAIN_STOPWORDS = [
    "video", "watch", "watching", "channel", "comment", "comments",
    "people", "person", "someone", "everyone",
    "really",
    "think", "know", "say", "said", "see",
    "go", "going",
    "one", "thing", "way", "time", "day",
    "would", "could", "should", "also",
    "thank", "thanks", "please",
]

# --- fixed values: extra stop words for topics, notebook variant ------------
DOMAIN_STOPWORDS_NOTEBOOK = [
    "video", "watch", "watching", "channel", "comment", "comments",
    "people", "person", "someone", "everyone",
    "like", "love", "good", "great", "really",
    "think", "know", "say", "said", "see",
    "make", "made", "get", "got", "go", "going",
    "one", "thing", "way", "time", "day",
    "would", "could", "should", "also",
    "thank", "thanks", "please",
]

# --- fixed values: stop words of the notebook phrase / keyword vectorisers --
PHRASE_STOPWORDS_NOTEBOOK = [
    "video", "people",
    "like", "say", "said", "know", "think", "see",
    "need", "make", "watch", "really", "would",
    "one", "get", "go", "also", "much", "love",
    "great", "good", "thank", "thanks",
]

# --- fixed values: workload settings ----------------------------------------
COMMENTS_PER_PAGE = 100
DEFAULT_MAX_PAGES = 3
UI_MAX_PAGES = 2
BATCH_SIZE = 32
LDA_SEED = 99
LDA_PASSES = 10
LDA_TOPICS = 3
LDA_NO_BELOW = 2
LDA_NO_ABOVE = 0.7
LDA_NO_ABOVE_NOTEBOOK = 0.8
PHRASE_MIN_DF = 2
PHRASE_MAX_DF = 0.8
TOP_PHRASES = 20
TOP_KEYWORDS = 20
TOP_KEYWORDS_NOTEBOOK = 25
TOPIC_KEYWORDS_N = 8
TOP_COMMENTS = 10
TOPIC_COMMENTS = 50
WORD_CLOUD_MAX_WORDS = 200
TREEMAP_WORDS = 10


# Spark ML's English stop list, in its own order.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don "
    "should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm "
    "you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't "
    "haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't "
    "couldn't cannot could here's how's let's ought that's there's what's when's where's who's "
    "why's would "
).split()
