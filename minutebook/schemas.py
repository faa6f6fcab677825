"""Explicit schemas of the record types."""

from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("number", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("legislationDate", T.StringType()),
    T.StructField("pdfUrl", T.StringType()),
    T.StructField("legislationType", T.StringType()),
    T.StructField("legislationTypeName", T.StringType()),
    T.StructField("finalAction", T.StringType()),
    T.StructField("needsReview", T.BooleanType()),
    T.StructField("sponsors", T.ArrayType(T.StringType())),
    T.StructField("sponsorConfidence", T.StringType()),
    T.StructField("isCharterAmendment", T.BooleanType()),
    T.StructField("claimType", T.StringType()),
    T.StructField("meetingDocId", T.LongType()),
])

MEETING = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("downloaded_at", T.StringType()),
    T.StructField("first", T.LongType()),
    T.StructField("data", T.ArrayType(ITEM)),
])

TERM = T.StructType([
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("office", T.StringType()),
])

ROSTER = T.StructType([
    T.StructField("councilmembers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("terms", T.ArrayType(TERM)),
    ]))),
])

COMMITTEES = T.StructType([
    T.StructField("committees", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
    ]))),
])

API_DOCUMENT = T.StructType([T.StructField("FormalNumber", T.StringType())])

LINK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("href", T.StringType()),
])

MEETING_EVENT = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("video_link", T.StringType()),
    T.StructField("votes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("comments", T.StringType()),
])

DETAIL_CONTENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    T.StructField("structured_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("meeting_history", T.ArrayType(MEETING_EVENT)),
    T.StructField("full_text", T.StringType()),
    T.StructField("full_text_html", T.StringType()),
])

DETAIL_RESULT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("content", DETAIL_CONTENT),
])

DETAIL_FILE = T.StructType(
    DETAIL_RESULT.fields + [T.StructField("results", T.ArrayType(DETAIL_RESULT))])

NEWS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("content_text", T.StringType()),
    T.StructField("content_html", T.StringType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("is_hidden", T.BooleanType()),
    T.StructField("admin_notes", T.StringType()),
    T.StructField("type", T.StringType()),
])

NEWS_LINKS = T.StructType([
    T.StructField("news_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("href", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("paper_number", T.StringType()),
    T.StructField("legislation_number", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("legislation_date", T.StringType()),
    T.StructField("legislation_type", T.StringType()),
    T.StructField("sponsors", T.ArrayType(T.StringType())),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("text_content", T.StringType()),
    T.StructField("char_count", T.LongType()),
    T.StructField("final_action", T.StringType()),
])

PP_PACKAGES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("meeting_date", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("item_count", T.LongType()),
])

PP_ITEMS = T.StructType([
    T.StructField("package_id", T.LongType()),
    T.StructField("row_num", T.IntegerType()),
    T.StructField("elms_id", T.StringType()),
    T.StructField("leg_id", T.StringType()),
    T.StructField("sponsor", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("leg_type", T.StringType()),
    T.StructField("committee", T.StringType()),
    T.StructField("page_start", T.IntegerType()),
    T.StructField("page_end", T.IntegerType()),
    T.StructField("pdf_path", T.StringType()),
    T.StructField("ocr_text", T.StringType()),
])

TABLES = {
    "items": T.StructType([T.StructField("date", T.StringType())] + ITEM.fields),
    "news": NEWS,
    "news_links": NEWS_LINKS,
    "documents": DOCUMENTS,
    "pp_packages": PP_PACKAGES,
    "pp_items": PP_ITEMS,
}
