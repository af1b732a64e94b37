"""Seed tables for tokens and lemmas (our own; table driven, no tagger).

Lemmas: an irregular-form table, then three suffix rules for regular plurals
(``-ies -> -y``, ``-sses -> -ss``, ``-s`` after a letter other than s/u/i).
Verb tenses other than the irregular ones are left as they are.
"""

IRREGULAR_LEMMAS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be",
    "been": "be", "being": "be", "has": "have", "had": "have",
    "having": "have", "does": "do", "did": "do", "done": "do", "doing": "do",
    "goes": "go", "went": "go", "gone": "go", "made": "make", "makes": "make",
    "said": "say", "says": "say", "saw": "see", "seen": "see", "sees": "see",
    "got": "get", "gets": "get", "gotten": "get", "took": "take",
    "taken": "take", "came": "come", "comes": "come", "knew": "know",
    "known": "know", "thought": "think", "told": "tell", "found": "find",
    "gave": "give", "given": "give", "felt": "feel", "left": "leave",
    "kept": "keep", "began": "begin", "begun": "begin", "wrote": "write",
    "written": "write", "ran": "run", "brought": "bring", "bought": "buy",
    "children": "child", "men": "man", "women": "woman", "feet": "foot",
    "teeth": "tooth", "mice": "mouse", "geese": "goose", "lives": "life",
    "wives": "wife", "knives": "knife", "leaves": "leaf", "better": "well",
    "best": "good", "worse": "bad", "worst": "bad", "videos": "video",
    "movies": "movie", "series": "series", "news": "news",
}

# Accent folding for the simple tokeniser, built by rule: every lower-case
# letter of Latin-1 Supplement and Latin Extended-A whose canonical
# decomposition starts with an ASCII letter maps to that letter.
def _fold_tables():
    import unicodedata
    src, dst = [], []
    for cp in range(0x00C0, 0x0180):
        ch = chr(cp)
        if not ch.islower():
            continue
        base = unicodedata.normalize("NFKD", ch)[0]
        if "a" <= base <= "z":
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _fold_tables()
