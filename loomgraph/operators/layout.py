"""Layout results (pages, paragraphs, figures, tables with cells) as tables, chunks, regions and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, text as T

SCHEMA = (
    "source_file_id string, pages array<struct<page_number:int,width:double,height:double,unit:string>>, "
    "paragraphs array<struct<content:string,role:string,bounding_regions:array<struct<page_number:int,polygon:array<double>>>>>, "
    "figures array<struct<id:string,caption:struct<content:string>,bounding_regions:array<struct<page_number:int,polygon:array<double>>>>>, "
    "tables array<struct<row_count:int,column_count:int,cells:array<struct<row_index:int,column_index:int,content:string,kind:string,bounding_regions:array<struct<page_number:int,polygon:array<double>>>>>>>"
)


def pages(results: DataFrame) -> DataFrame:
    return results.select("source_file_id", F.explode("pages").alias("p")).select("source_file_id", "p.*").where("page_number > 0")


def grids(results: DataFrame) -> DataFrame:
    """(source_file_id, t, page_number, grid): each table as a dense grid of (text, header); the last cell of a place wins."""
    tables = results.select("source_file_id", F.posexplode("tables").alias("t", "x"))
    rows = F.greatest(F.coalesce("x.row_count", F.lit(0)), F.array_max(F.col("x.cells.row_index")) + 1)
    cols = F.greatest(F.coalesce("x.column_count", F.lit(0)), F.array_max(F.col("x.cells.column_index")) + 1)

    def cell(r: Column, c: Column) -> Column:
        own = F.filter(F.col("x.cells"), lambda k: (k["row_index"] == r) & (k["column_index"] == c))
        return F.struct(F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.lit("")).alias("text"), F.coalesce(F.try_element_at(own, F.lit(-1))["kind"] == "columnHeader", F.lit(False)).alias("header"))

    grid = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: cell(r, c)))
    page = F.get(F.get(F.filter(F.col("x.cells.bounding_regions"), lambda b: F.size(b) > 0), F.lit(0)), F.lit(0))["page_number"]
    return tables.where("size(x.cells) > 0").select("source_file_id", "t", page.alias("page_number"), grid.alias("grid"))


def table_html(grid: str = "grid") -> Column:
    """Header rows in thead, the others in tbody; texts escaped."""

    def row(r: Column) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.when(c["header"], F.concat(F.lit("<th>"), T.escape_html(c["text"]), F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), T.escape_html(c["text"]), F.lit("</td>")))), ""), F.lit("</tr>"))

    is_head = lambda r: F.exists(r, lambda c: c["header"])
    head = F.array_join(F.transform(F.filter(F.col(grid), is_head), row), "")
    body = F.array_join(F.transform(F.filter(F.col(grid), lambda r: ~is_head(r)), row), "")
    return F.concat(F.lit("<table>"), F.when(head != "", F.concat(F.lit("<thead>"), head, F.lit("</thead>"))).otherwise(""), F.lit("<tbody>"), body, F.lit("</tbody></table>"))


def plain(grid: str = "grid") -> Column:
    return F.array_join(F.transform(F.col(grid), lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "\t")), "\n")


def embedding_text(grid: str = "grid") -> Column:
    """Rows as cells between bars; a table with header cells begins with them (the last of each column), after "Table: "."""
    heads = F.filter(F.col(grid), lambda r: F.exists(r, lambda c: c["header"]))
    own = F.filter(F.transform(F.col(grid), lambda r: F.transform(r, lambda c: F.when(~c["header"], c["text"]))), lambda r: F.exists(r, lambda c: c.isNotNull()))
    line = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    width = F.size(F.get(F.col(grid), F.lit(0)))
    top = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(heads, F.lit("").cast("string"), lambda a, r: F.when(F.get(r, i)["header"], F.get(r, i)["text"]).otherwise(a)))
    first = F.when(F.size(heads) > 0, F.array(F.concat(F.lit("Table: "), line(top)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, F.transform(own, line)), "\n")


def table_chunks(results: DataFrame, at) -> DataFrame:
    rows = grids(results).withColumns({"content_html": table_html(), "content": plain(), "embedding_text": embedding_text()})
    hash_ = ids.content_hash("content_html")
    element = ids.element_id("source_file_id", F.lit("table"), "page_number", "t", hash_)
    return rows.select(ids.chunk_id("source_file_id", F.lit("table_html"), hash_).alias("chunk_id"), "source_file_id", element.alias("document_element_id"), F.lit("table_html").alias("chunk_type"), "content", "content_html", "embedding_text", "page_number", element.alias("table_id"), hash_.alias("content_hash"), at.alias("created_at"))


def html_cells(tables: DataFrame, key: str = "document_element_id", markup: str = "content_html") -> DataFrame:
    """(key, row_index, col_index, text): non-empty th and td cells of table markup; an empty cell still takes its column."""
    rows = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit("(?is)<tr\\b[^>]*>(.*?)(?=<tr\\b|</tr>|</table>|$)"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit("(?is)<t[hd]\\b[^>]*>(.*?)(?=<t[hd]\\b|</t[hd]>|$)"), F.lit(1))
    out = tables.select(key, F.posexplode(rows).alias("row_index", "r")).select(key, "row_index", F.posexplode(cells(F.col("r"))).alias("col_index", "c"))
    return out.withColumn("text", T.strip_html("c")).where("text != ''").drop("c")


def paragraph_regions(results: DataFrame) -> DataFrame:
    """A region for each bounding region of paragraphs, with points as shares of the page."""
    spots = results.select("source_file_id", F.posexplode("paragraphs").alias("i", "p")).select("source_file_id", "i", "p.content", "p.role", F.posexplode("p.bounding_regions").alias("j", "b"))
    at = spots.select("source_file_id", "i", "j", "content", "role", "b.page_number", "b.polygon")
    return at.join(pages(results).select("source_file_id", "page_number", "width", "height"), ["source_file_id", "page_number"], "left").select("source_file_id", "i", "j", "page_number", F.coalesce("role", F.lit("ocr_text")).alias("label"), F.col("content").alias("text"), F.to_json(T.points("polygon")).alias("polygon_json"), F.to_json(T.normalized_points("polygon", "width", "height")).alias("normalized_polygon_json"))


def figures(results: DataFrame) -> DataFrame:
    """(source_file_id, figure_id, page_number, caption, box): the first bounding region (4 numbers or more) in points."""
    rows = results.select("source_file_id", F.posexplode("figures").alias("i", "f")).withColumn("b", F.get("f.bounding_regions", F.lit(0))).where("size(b.polygon) >= 4")
    xs = F.filter(F.col("b.polygon"), lambda v, i: i % 2 == 0)
    ys = F.filter(F.col("b.polygon"), lambda v, i: i % 2 == 1)
    box = F.transform(F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), lambda v: v * 72)
    return rows.select("source_file_id", F.coalesce("f.id", F.col("i").cast("string")).alias("figure_id"), F.col("b.page_number").alias("page_number"), F.col("f.caption.content").alias("caption"), box.alias("box"))


def unique_images(images: DataFrame) -> DataFrame:
    """Embedded images without repeats within a document: first of each hash by pos."""
    key = ["source_file_id", "image_hash"]
    every = F.struct(*[F.col(c) for c in images.columns])
    return images.groupBy(*key).agg(F.min_by(every, "pos").alias("r")).select("r.*")


def asset_rows(images: DataFrame, at) -> DataFrame:
    return images.select(ids.image_id("source_file_id", "image_hash").alias("image_id"), "source_file_id", F.coalesce("asset_type", F.lit("figure")).alias("asset_type"), "page_number", "caption", "blob_url", "image_hash", F.col("blob_url").isNull().alias("is_placeholder"), at.alias("created_at"))


def figure_regions(assets: DataFrame, at) -> DataFrame:
    """One region for each figure, with full confidence."""
    return assets.select(ids.region_id("image_id", F.lit("figure_region"), F.lit(""), F.lit(0)).alias("visual_region_id"), "image_id", F.lit("figure_region").alias("region_type"), F.col("caption").alias("text"), F.lit(1.0).alias("confidence"), at.alias("created_at"))
