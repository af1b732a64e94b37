"""Seed tables for the rule-based (lexicon) sentiment model.

The scoring rules and their constants are the published ones of the
valence-aware lexicon method (Hutto & Gilbert, ICWSM 2014).  The word list
below is a small choice of words; their valences (-4..+4) follow the method's
published word list (MIT licence), from memory and not compared with it.  Any
``(token, valence)`` table can be passed instead (``lexicon_table``).  Booster, dampener and
negation words must not appear in the lexicon (checked in tests): the context
rules rely on it.
"""

# --- fixed values: published rule constants ---------------------------------
BOOSTER_INCREMENT = 0.293
CAPS_INCREMENT = 0.733
NEGATION_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
EXCLAMATION_STEP = 0.292
EXCLAMATION_MAX = 4
QUESTION_STEP = 0.18
QUESTION_MAX_AMP = 0.96
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
DISTANCE_DECAY = (1.0, 0.95, 0.9)

SEED_LEXICON = {
    # negative
    "scum": -2.9, "idiot": -2.3, "idiots": -2.4, "trash": -1.5, "worthless": -1.9,
    "moron": -2.2, "morons": -2.2, "pathetic": -2.2, "stupid": -2.4, "loser": -2.4,
    "losers": -2.3, "disgusting": -2.4, "no": -1.2, "bad": -2.5, "worse": -2.1,
    "worst": -3.1, "hate": -2.7, "hated": -3.2, "hates": -1.9, "awful": -2.0,
    "terrible": -2.1, "horrible": -2.5, "boring": -1.3, "annoying": -1.7,
    "sad": -2.1, "angry": -2.3, "ugly": -2.3, "wrong": -2.1, "fail": -2.5,
    "failed": -2.3, "lame": -1.8, "dumb": -2.3, "useless": -1.8, "poor": -2.1,
    "fake": -2.1, "lie": -1.6, "lies": -1.8, "liar": -2.5, "sucks": -1.5,
    "garbage": -2.1, "nasty": -2.6, "cringe": -1.6, "problem": -1.7, "wtf": -2.8,
    "kill": -3.7, "died": -2.6, "war": -2.9, "sorry": -0.3, "cry": -2.1,
    # positive
    "best": 3.2, "good": 1.9, "great": 3.1, "love": 3.2, "loved": 2.9,
    "loves": 2.7, "like": 2.0, "liked": 1.8, "nice": 1.8, "awesome": 3.1,
    "amazing": 2.8, "excellent": 2.7, "wonderful": 2.7, "beautiful": 2.9,
    "fantastic": 2.6, "happy": 2.7, "funny": 1.9, "cool": 1.3, "perfect": 2.7,
    "brilliant": 2.8, "glad": 2.0, "thanks": 1.9, "thank": 1.5, "fun": 2.3,
    "helpful": 1.9, "interesting": 1.7, "enjoy": 2.2, "enjoyed": 2.3, "win": 2.8,
    "yes": 1.7, "true": 1.8, "respect": 2.1, "legend": 1.7, "super": 2.9,
    "lol": 1.8, "haha": 2.0, "wow": 2.8, "agree": 1.5, "better": 1.9,
    "smart": 1.7, "hope": 1.9, "support": 1.7, "proud": 2.1, "favorite": 2.0,
    "inspiring": 2.3, "masterpiece": 3.1, "genius": 2.5, "well": 1.1, "ok": 1.2,
}

# Boosters push a following hit away from zero, dampeners towards it.
BOOSTERS = [
    "absolutely", "amazingly", "completely", "considerably", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely",
    "fully", "greatly", "highly", "hugely", "incredibly", "intensely",
    "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally",
    "tremendously", "truly", "unbelievably", "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally",
    "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "never", "none", "nope", "nor", "not", "nothing", "nowhere", "shouldnt",
    "wasnt", "werent", "without", "wont", "wouldnt", "rarely", "seldom",
]
# Any token ending in this is a negation too ("don't", "isn't").
NEGATION_SUFFIX = "n't"
