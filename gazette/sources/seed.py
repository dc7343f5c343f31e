"""Seed-if-empty for the feed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------
# Default feeds, in order: (uri, name, category, is_aggregator).
SEED_FEEDS = [
    ("https://api.axios.com/feed/", "Axios", "Top", False),
    ("http://feeds.foxnews.com/foxnews/tech", "Fox News", "Tech", False),
    ("http://feeds.nbcnews.com/nbcnews/public/tech", "NBC News", "Technology", False),
    ("http://feeds.skynews.com/feeds/rss/technology.xml", "Sky News", "Technology", False),
    ("http://feeds.washingtonpost.com/rss/rss_innovations", "Washington Post", "Innovations", False),
    ("https://feeds.a.dj.com/rss/RSSWSJD.xml", "WSJ", "Technology: What's News", False),
    ("https://feeds.feedburner.com/TechCrunch", "TechCrunch", "All Content", True),
    ("https://feeds.feedburner.com/TheHackersNews", "THN", "Latest News", True),
    ("https://feeds.npr.org/1019/rss.xml", "NPR", "Technology", False),
    ("https://gizmodo.com/rss", "Gizmodo", "All News", False),
    ("https://news.crunchbase.com/feed/", "CrunchBase", "News", False),
    ("https://news.google.com/news/rss/headlines/section/topic/TECHNOLOGY", "Google News", "Technology", True),
    ("https://news.google.com/news/rss/headlines/section/topic/BUSINESS", "Google News", "Business", True),
    ("https://nypost.com/tech/feed/", "NYPost", "Tech", False),
    ("https://readwrite.com/feed/", "Readwrite", "All News", False),
    ("https://rss.nytimes.com/services/xml/rss/nyt/Technology.xml", "NYT", "Technology", False),
    ("https://stringer.sdxcentral.com/rss/sdxcentral-news-feed.rss", "SDxCentral", "News", False),
    ("https://thenewstack.io/blog/feed", "The New Stack", "Recent Stories", False),
    ("https://venturebeat.com/feed/", "VentureBeat", "Latest News", False),
    ("https://www.businessinsider.com/sai/rss", "Business Insider", "Tech Insider", False),
    ("https://www.buzzfeed.com/tech.xml", "BuzzFeed News", "Tech", False),
    ("https://www.cnbc.com/id/19854910/device/rss/rss.html", "CNBC", "Technology", False),
    ("https://www.computerweekly.com/rss/All-Computer-Weekly-content.xml", "ComputerWeekly", "All Content", False),
    ("https://www.economist.com/business/rss.xml", "The Economist", "Business", False),
    ("https://www.economist.com/science-and-technology/rss.xml", "The Economist", "Science and Technology", False),
    ("https://www.engadget.com/rss.xml", "Engadget", "All News", False),
    ("https://www.eweek.com/rss.xml", "eWEEK", "Last Articles", False),
    ("https://www.digitaltrends.com/news/feed/", "Digital Trends", "Tech News", False),
    ("https://www.ft.com/companies?format=rss", "FT", "Companies", False),
    ("https://www.ft.com/entrepreneurship?format=rss", "FT", "Entrepreneurship", False),
    ("https://www.ft.com/technology?format=rss", "FT", "Technology", False),
    ("https://www.geekwire.com/feed/", "GeekWire", "News", False),
    ("https://www.infotech.com/rss/infotech.xml", "Info-Tech", "All", False),
    ("https://www.infoworld.com/news/index.rss", "InfoWorld", "News", False),
    ("https://www.itworld.com/index.rss", "ITworld", "All News", False),
    ("https://www.jpost.com/rss/rssfeedsjposttech", "JPost.com", "Hi-Tech News", False),
    ("https://www.jpost.com/rss/rssfeedsjposttechbusinessandinnovation", "JPost.com", "Business & Tech", False),
    ("https://www.technologyreview.com/feed/", "MIT Technology Review", "All Stories", False),
    ("https://www.techrepublic.com/rssfeeds/articles/", "TechRepublic", "Articles", False),
    ("https://www.techtimes.com/rss/sections/personaltech.xml", "Tech Times", "Tech", False),
    ("https://www.theguardian.com/uk/technology/rss", "The Guardian", "Technology", False),
    ("https://www.theregister.com/headlines.atom", "TheRegister", "Headlines", False),
    ("https://www.telegraph.co.uk/technology/rss.xml", "The Telegraph", "Tech", False),
    ("https://www.theverge.com/tech/rss/index.xml", "The Verge", "Tech Posts", False),
    ("https://www.thewrap.com/category/tech/feed/", "TheWrap", "TheWrapTech", False),
    ("https://www.washingtontimes.com/rss/headlines/culture/technology/", "The Washington Times", "Technology", False),
    ("https://www.wired.com/feed/category/business/latest/rss", "Wired", "Business", False),
    ("https://www.wired.com/feed/category/security/latest/rss", "Wired", "Security", False),
    ("https://www.zdnet.com/news/rss.xml", "ZDNet", "Latest News", False),
]

FEED_SCHEMA = ("id int, last_publish_time timestamp, uri string, name string, category string, "
               "etag string, modified string, is_aggregator boolean")


def seed_table(spark: SparkSession) -> DataFrame:
    """The default feeds with ids 1..49, no state."""
    rows = [(i + 1, None, u, n, c, None, None, a) for i, (u, n, c, a) in enumerate(SEED_FEEDS)]
    return spark.createDataFrame(rows, FEED_SCHEMA)


def seed_if_empty(feeds: DataFrame) -> DataFrame:
    """``feeds`` unchanged when it has any row, else the default feeds.

    The emptiness test is one bounded action (``isEmpty`` reads at most one row).
    """
    if feeds.isEmpty():
        return seed_table(feeds.sparkSession).select(*feeds.columns)
    return feeds
