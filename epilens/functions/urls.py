"""URL parts and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epilens.functions.lexicon import any_of

# Hosts and paths that are no articles.
BLOCKED = ["google.com", "news.google.com", "gstatic.com", "googleusercontent.com", "accounts.google.com", "policies.google.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "tiktok.com"]
NOT_ARTICLE = [
    "/tentang-kami", "/tentang_kami", "/tentang", "/about", "/about-us", "/redaksi", "/kontak", "/contact", "/privacy", "/privacy-policy", "/terms", "/disclaimer",
    "/pedoman", "/sitemap", "/rss", "/tag/", "/kategori/", "/category/", "/author/", "/login", "/register", "/search", "/cari",
]
HINTS = ["/berita/", "/news/", "/daerah/", "/kesehatan/", "/regional/", "/read/", "/nasional/", "/artikel/", "/siaran/", "/features/"]


def host(c: Column) -> Column:
    """Lower-case host without www.; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def query_part(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def url_class(c: Column) -> Column:
    """blocked, not_article, article (a path hint) or other; blocked hosts match by substring."""
    p = F.lower(path(c))
    return F.when(host(c) == "", "none").when(any_of(host(c), BLOCKED), "blocked").when(any_of(p, NOT_ARTICLE) | ((F.length(F.regexp_replace(p, "/+$", "")) == 0) & F.lower(query_part(c)).rlike("(^|&)(s|q|search|query)=")), "not_article").when(any_of(p, HINTS), "article").otherwise("other")
