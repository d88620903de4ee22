"""Tables of the link code. They are part of the format: changing one changes every code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: characters with symbols of their own, in symbol order.
LITERALS = "eaot-ir/sncl.mwdpu%hg02b1kf8yv359476D=B_EzAjx&C?"

# Fixed values of the format: substrings with symbols of their own.
PRIMARY = (
    ".com/", "www.", "product", ".html", "robots.txt", ".org/", "category", "index.php", "search", "news", ".com",
)

# Fixed values of the format: substrings behind the extension symbol, by index.
EXTENDED = (
    "page", "blog", ".de/", ".ru/", "article", "github.", "gitlab.", "bitbucket.", "/tree/", "/blob/", "/issues/",
    "/pull/", "/commit/", "/releases/", "/src/", "/docs/", "x.com/", "twitter.com/", "/status/", "/statuses/",
    ".net/", "content", "detail", "author", ".php", "collection", "catalog", "id=", "event", "view", "shop",
    "publication", "archive", ".jp/", "forum", "categories", "2026", "post", "2025", "/tag/", ".edu", ".fr/",
    "services", ".it/", ".pl/", ".br/", "video", "2024", "order=", "profile", "download", "produkt", "attachment",
    "type=", ".nl/", ".gov", "gallery", "portfolio", ".pdf", "utm_source=", "/uploads/", ".aspx",
    "/citationstylelanguage/", "2023", "item", "2022", ".cn/", ".cz/", "wiki", "noticias", ".au/", "?showComment=",
    ".info/", "&utm_medium=", ".htm", "&utm_campaign=", "login", "2021", ".es/", ".ca/", "2020", "sort=", "/en/",
    "/04/", "contact", "resources", ".xn--p1ai/", "default", ".ch/", ".ua/", "tags", "action=", ".eu/", "/10/",
    ".org", "redirect_to=", "projects", ".in/", "?submissionId=", "/03/", "mode=", "/handle/", "lang=", ".co.kr/",
    "/06/", "uncategorized", "/05/", ".vn/", ".ro/", "/12/", ".at/", ".be/", ".uk/", ".tw/", ".hu/", ".se/",
    ".co.il/", ".gr/", ".tr/", "/11/", "/01/", "/topic", "obituaries", ".co/", ".online/", ".id/", "comments",
    "/09/",
)

# Fixed values of the format: beginnings of shared links, by index.
SHARED = (
    "youtube.com/watch?v=", "youtu.be/", "m.youtube.com/watch?v=", "music.youtube.com/watch?v=", "soundcloud.com/",
    "open.spotify.com/", "spotify.link/", "podcasts.apple.com/", "music.apple.com/", "github.com/",
    "gist.github.com/", "gitlab.com/", "bitbucket.org/", "x.com/", "twitter.com/", "instagram.com/",
    "www.instagram.com/", "tiktok.com/", "www.tiktok.com/", "vm.tiktok.com/", "reddit.com/r/", "www.reddit.com/r/",
    "old.reddit.com/r/", "redd.it/", "bsky.app/profile/", "threads.net/", "www.threads.net/", "facebook.com/",
    "www.facebook.com/", "fb.watch/", "linkedin.com/", "www.linkedin.com/", "medium.com/", "substack.com/",
    "notion.so/", "docs.google.com/", "drive.google.com/", "maps.google.com/", "goo.gl/maps/", "dropbox.com/",
    "box.com/", "figma.com/", "canva.com/", "miro.com/", "slack.com/", "discord.com/", "discord.gg/", "twitch.tv/",
    "clips.twitch.tv/", "vimeo.com/", "dailymotion.com/", "imgur.com/", "i.imgur.com/", "flickr.com/",
    "pinterest.com/", "pin.it/", "amazon.com/", "amzn.to/", "ebay.com/", "etsy.com/", "producthunt.com/",
    "news.ycombinator.com/", "lobste.rs/", "stackoverflow.com/questions/", "stackexchange.com/questions/",
    "arxiv.org/abs/", "doi.org/", "wikipedia.org/wiki/", "en.wikipedia.org/wiki/", "developer.mozilla.org/",
    "docs.python.org/", "npmjs.com/package/", "crates.io/crates/", "pypi.org/project/", "rubygems.org/gems/",
    "huggingface.co/", "kaggle.com/", "observablehq.com/", "codesandbox.io/", "codepen.io/", "replit.com/",
    "vercel.app/", "netlify.app/", "workers.dev/",
)

# Fixed values of the format: beginnings of video links whose id of 11 characters is packed.
VIDEO = ("youtube.com/watch?v=", "youtu.be/", "m.youtube.com/watch?v=", "music.youtube.com/watch?v=")

# Fixed values of the format: alphabets of payloads and packed runs.
SERVER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~!$&'()*+,;=:@/?"
CLIENT = SERVER + "#"
WORDS64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
LOWER27 = "abcdefghijklmnopqrstuvwxyz-"
HEX16 = "0123456789abcdef"
CJK_FIRST, CJK_SIZE = 0x4E00, 0x9FFF - 0x4E00 + 1

DICTIONARY = PRIMARY + EXTENDED
#: Symbols after literals and primary entries.
ESCAPE = len(LITERALS) + len(PRIMARY)
NUMBER, REFERENCE, EXTENSION, END = ESCAPE + 1, ESCAPE + 2, ESCAPE + 3, ESCAPE + 4
SYMBOLS = END + 1

VERSIONS = ("0", "1")


def dimension_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables as small frames, for joins on coverage."""
    rows = [("primary", i, v) for i, v in enumerate(PRIMARY)] + [("extended", i, v) for i, v in enumerate(EXTENDED)]
    return {
        "model_literals": spark.createDataFrame(list(enumerate(LITERALS)), "id int, value string"),
        "model_dictionary": spark.createDataFrame(rows, "tier string, id int, value string"),
        "model_share": spark.createDataFrame(list(enumerate(SHARED)), "id int, value string"),
    }
