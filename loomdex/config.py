"""All constants of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# The search stop words.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by cannot could did do does "
    "doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself let me "
    "more most must my myself no nor not of off on once only or other ought our ours ourselves out over own same shall she should so some such than that "
    "the their theirs them themselves then there these they this those through to too under until up us very was we were what when where which while who "
    "whom why will with would you your yours yourself yourselves".split()
)

# The crawl report's stop words (a public default list of English stop words, contractions included).
CRAWL_STOP_WORDS = tuple(
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could "
    "couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's "
    "her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my "
    "myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some "
    "such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under "
    "until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't "
    "would wouldn't you you'd you'll you're you've your yours yourself yourselves".split()
)

# Extensions that are not crawled.
BAD_EXTENSIONS = tuple(
    "css js bmp gif jpg jpeg ico png tif tiff mid mp2 mp3 mp4 wav avi mov mpeg ram m4v mkv ogg ogv pdf ps eps tex ppt pptx ppsx doc docx xls xlsx names "
    "data dat exe bz2 tar msi bin 7z psd dmg iso epub dll cnf tgz sha1 thmx mso arff rtf jar csv rm smil wmv swf wma zip rar gz scm img".split()
)

# Path endings that count as pages of markup.
PAGE_ENDINGS = (".html", ".xml", ".xhtml", ".phtml", ".shtml", ".htm", ".php", ".aspx", ".asp", ".jsp")


@dataclass(frozen=True)
class Config:
    """Thresholds, weights and cut-offs; the defaults are the compatible ones."""

    title_weight: float = 25.0
    tag_weights: tuple[tuple[str, float], ...] = (("h1", 5.0), ("h2", 3.0), ("h3", 2.0), ("b", 1.2), ("strong", 1.2))
    results: int = 10
    cutoffs: tuple[int, ...] = (100, 200, 400, 800, 1600)
    bigram_cutoff: int = 999
    min_length: int = 2
    bucket_tokens: int = 100
    near_dup: float = 0.975
    referrer_similarity: float = 0.875
    trap_similarity: float = 0.85
    trap_hits: int = 3
    path_repeats: int = 3
    low_value_tokens: int = 150
    low_value_ratio: float = 0.5
    low_value_tags: int = 3
    allowed_domains: tuple[str, ...] = ("example.com", "example.net", "example.org")
    stem: bool = True
    contractions: bool = True
    #: count query frequencies over analysed words instead of raw ones
    analyzed_qf: bool = False
    #: add the bigram bonus after the cosine score, which otherwise replaces it
    bigram_bonus: bool = False


DEFAULT = Config()
