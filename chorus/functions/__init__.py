from chorus.functions.text import (  # noqa: F401
    clean_strict, clean_light, video_id, sentiment_label, simple_tokens,
    word_tokens, lemma_of, model_tokens, vectorizer_tokens, is_all_caps,
    strip_outer_punct, count_char,
)
