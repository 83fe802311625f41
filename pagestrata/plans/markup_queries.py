"""More registered queries: pages read as tokens and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.operators import markup_tree
from pagestrata.plans import sql
from pagestrata.plans.registry import register
from pagestrata.sources import views


@register(f"WITH {sql.ANCHORS} SELECT page_id, CAST(pos AS INTEGER) AS pos, url, replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text, rel, download, in_form FROM anchors")
def link_tokens(spark, sf_dir):
    """UD-02: anchors read from tokens, so that comments, scripts and quoted signs are what they are."""
    found = markup_tree.links(views.decorated_pages(spark, sf_dir).withColumnRenamed("url", "page_url"))
    return found.select("page_id", "pos", urls.resolve(F.col("href"), F.col("page_url")).alias("url"), "text", "rel", "download", "in_form")


@register(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)^.*?<body>|</body>.*$', '', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<(script|style|noscript|textarea)[^>]*>.*?</(script|style|noscript|textarea)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS t FROM b)
SELECT page_id, sha256(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')) AS text_sha256 FROM t""")
def body_text(spark, sf_dir):
    """UD-03: the text content of bodies, entities decoded and no space put in for a tag."""
    found = markup_tree.texts(views.table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.sha2("text", 256).alias("text_sha256"))


#: Posts of a forum in three themes, by turn: a marker inside its message, microdata, and classes.
LEAD = "A post that begins with more than forty characters: "
THEMES = (
    '<div class="message"><div><a id="post-{turn}"></a></div><p><a href="/members/{role}">{role}</a><div class="message-body">{text}<div> nested</div></div><time datetime="2024-01-02">then</time></div>',
    "<article id='post-{turn}'><meta itemprop=position content='{turn}0'><header><a href='/user/x'><img src=x></a></header><span itemprop=author><b itemprop=name>{role}</b></span><div itemprop='text'>{text}<blockquote>quoted <b>more</b></blockquote></div></article>",
    '<div title="a > b" id="post_{turn}" class="post"><header><span class="username">{role}</span></header><!-- <div id="post-0"> --><span class="post-number">#7{turn}</span><div class="post-content">{text}<script>"</div>"</script></div></div>',
)


@register(f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, '{LEAD}' || coalesce(text, '') || ' end' AS text, turn % 3 AS theme FROM conversations)
SELECT conv_id AS page_id, conv_id || '#post' || CASE theme WHEN 2 THEN '_' ELSE '-' END || turn AS post_id, role AS author, CASE theme WHEN 0 THEN '/members/' || role END AS profile, CASE theme WHEN 0 THEN '2024-01-02' END AS written,
  CAST(CASE theme WHEN 0 THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) WHEN 1 THEN turn * 10 ELSE CAST('7' || turn AS BIGINT) END AS INTEGER) AS number, sha256(text || CASE theme WHEN 0 THEN ' nested' ELSE '' END) AS body_sha256 FROM c""")
def forum_containers(spark, sf_dir):
    """UD-06, CP-07: posts of forum pages made from conversations: markers inside messages, microdata, and bodies that hold elements."""
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    filled = lambda theme: F.replace(F.replace(F.replace(F.lit(theme), F.lit("{turn}"), F.col("turn").cast("string")), F.lit("{role}"), F.coalesce("role", F.lit(""))), F.lit("{text}"), F.concat(F.lit(LEAD), escaped, F.lit(" end")))
    theme = F.when(F.col("turn") % 3 == 0, filled(THEMES[0])).when(F.col("turn") % 3 == 1, filled(THEMES[1])).otherwise(filled(THEMES[2]))
    posts = views.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("turn", theme.alias("post")))).alias("posts"))
    body = F.array_join(F.transform("posts", lambda p: p["post"]), "\n")
    pages = posts.select("page_id", F.concat(F.lit("<!DOCTYPE html><html><head><title>Thread</title></head><body><div class=thread>"), body, F.lit("</div></body></html>")).alias("html"))
    return markup_tree.forum_posts(pages).select("page_id", "post_id", "author", "profile", "written", "number", F.sha2("body", 256).alias("body_sha256"))
