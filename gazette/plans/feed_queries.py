"""Queries over feeds, sitemaps and JSON bodies that are made of the page table, a body for each page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.plans.registry import query
from gazette.plans.views import Views
from gazette.sources import feeds


@query("a3_feed_items", "SELECT page_id, 0 AS pos, CASE WHEN page_id % 5 = 1 THEN 'Untitled Notification' ELSE concat('Page ', page_id, ' & more') END AS title, url AS link, CASE WHEN page_id % 3 = 0 THEN '' ELSE substring(repeat(concat('About ', page_id, '. '), 40), 1, 300) END AS snippet FROM {pages}")
def _(v: Views) -> DataFrame:
    title = "if(page_id % 5 = 1, '', concat('<title><![CDATA[Page ', page_id, ' & more]]></title>'))"
    rss = f"concat('<rss><channel><title>T</title><item>', {title}, '<link>', replace(url, '&', '&amp;'), '</link><description>', repeat(concat('About ', page_id, '. '), 40), '</description></item></channel></rss>')"
    atom = f"concat('<feed><entry>', {title}, '<link href=\"', replace(url, '&', '&amp;'), '\"/></entry></feed>')"
    bodies = v.raw("pages").selectExpr("page_id", f"if(page_id % 3 = 0, {atom}, {rss}) as body")
    return feeds.feed_items(bodies, key="page_id").select("page_id", "pos", "title", "link", "snippet")


@query("a4_sitemap_entries", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'sitemap' ELSE 'url' END AS kind, url AS loc, CASE WHEN page_id % 4 <> 0 THEN '2024-01-05' END AS lastmod FROM {pages}")
def _(v: Views) -> DataFrame:
    loc = "concat('<loc> ', replace(url, '&', '&amp;'), ' </loc>')"
    bodies = v.raw("pages").selectExpr("page_id", f"if(page_id % 4 = 0, concat('<sitemapindex><sitemap>', {loc}, '</sitemap></sitemapindex>'), concat('<urlset><url>', {loc}, '<lastmod>2024-01-05</lastmod></url></urlset>')) as body")
    return feeds.sitemap_entries(bodies, key="page_id")


@query("a5_json_items", "SELECT page_id, 0 AS pos, concat('Page ', page_id) AS title, url AS link, CASE WHEN page_id % 2 = 0 THEN 'short' ELSE '' END AS description FROM {pages} WHERE page_id % 5 <> 0")
def _(v: Views) -> DataFrame:
    record = "concat('{\"', element_at(array('url', 'link', 'href'), cast(page_id % 3 + 1 as int)), '\":\"', url, '\",\"name\":\"Page ', page_id, '\"', if(page_id % 2 = 0, ',\"summary\":\"short\"', ''), '}')"
    bodies = v.raw("pages").selectExpr("page_id", f"case when page_id % 5 = 0 then '{{oops' when page_id % 7 = 0 then concat('[', {record}, ']') else concat('{{\"meta\":1,\"results\":[', {record}, ']}}') end as body")
    return feeds.json_items(bodies, key="page_id")[0].select("page_id", "pos", "title", "link", "description")


@query("a6_body_formats", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rss' WHEN 2 THEN 'sitemap' WHEN 3 THEN 'json' ELSE 'html' END AS format FROM {pages}")
def _(v: Views) -> DataFrame:
    bodies = v.raw("pages").selectExpr("page_id", "if(page_id % 5 = 0, concat('https://a.example.org/', page_id, '.PDF?x=1'), url) as url", "if(page_id % 5 = 3, 'application/json', 'text/html') as content_type", "case page_id % 5 when 1 then ' <?xml?><rss>' when 2 then '<urlset>' when 3 then '{}' else html end as body", "cast(null as string) as declared")
    return feeds.body_format(bodies).select("page_id", "format")


@query("a2_page_facts", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '[\s ]+', ' ', 'g')) AS title FROM {pages} WHERE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) <> ''""")
def _(v: Views) -> DataFrame:
    return feeds.page_facts(v.raw("pages")).where(F.col("title").isNotNull()).select("page_id", "title")
