from chorus.sources.inputs import (  # noqa: F401
    read_table, comments, short_comments, url_samples, landed_pages,
)
from chorus.sources.pages import (  # noqa: F401
    PAGE_SCHEMA, comments_from_pages, page_cap, page_errors, multi_video,
    with_video_id,
)
