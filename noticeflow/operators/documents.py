"""Documents: per-document fields, lookup by candidates, file manifest."""

from pyspark.sql import functions as F

from noticeflow.functions.documents import assembled_text, content_hash, is_pdf, ok_status
from noticeflow.functions.fields import with_text_fields
from noticeflow.functions.text import non_blank, nz
from noticeflow.functions.urls import safe_file_name

#: Bits of the link filter for each link, and at most: 2^27 bits are the 16 MB that are broadcast.
BITS_EACH, MOST_BITS = 16, 1 << 27
_BITMAP = 1 << 15  # bits of one value of the bitmap aggregate

# candidates without a notification link are spread over this many keys that match nothing
_BLANK_KEYS = 4096


def usable(documents):
    """Fetched without an error status and a PDF by type or by name."""
    return documents.filter(
        ok_status(F.col("status")) & is_pdf(F.col("content_type"), F.col("final_url"))
    )


def document_texts(documents, document_dir="documents", keep=()):
    """Usable documents as text with hash and file; unreadable ones keep hash and file."""
    return usable(documents).select(
        *keep,
        "request_url",
        "final_url",
        content_hash(F.col("content")).alias("document_hash"),
        F.concat(F.lit(document_dir + "/"), safe_file_name(F.col("final_url")))
        .alias("source_document"),
        assembled_text(F.col("pages")).alias("text"),
    )


def document_fields(documents, document_dir="documents", keep=()):
    """Usable documents with their fields instead of their text.

    Fields depend on the text alone, so they are taken once per document, before any
    candidate is joined; no text travels through a shuffle.
    """
    return with_text_fields(document_texts(documents, document_dir, keep))


def link_filter(links, bits, column="notification_url"):
    """Bitmaps (`bucket`, `bitmap`) of the hashed links, at most `bits` bits in all."""
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    return links.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def linked_documents(documents, links):
    """The documents that a link (`notification_url`) may name, before anything of them is read into fields.

    All documents with a link stay and a sixteenth at most of the others, as long as there are up to
    MOST_BITS / BITS_EACH links; of more links the filter keeps its size and lets more through.  Exact
    matching is left to the join with candidates, so results don't depend on it.  `links` should be a
    written table, as it is counted first.
    """
    wanted = BITS_EACH * max(links.count(), 1)
    bits = min(MOST_BITS, max(_BITMAP, 1 << (wanted - 1).bit_length()))
    bitmaps = F.broadcast(link_filter(links, bits))
    place = F.pmod(F.xxhash64("request_url"), F.lit(bits)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.substring(bitmaps["bitmap"], F.floor(at / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
    return documents.join(bitmaps, (F.bitmap_bucket_number(place) == bitmaps["bucket"]) & is_set, "left_semi")


def latest_documents(documents, order):
    """One row per requested URL where landed fetches repeat: the last one by `order`."""
    others = [c for c in documents.columns if c != "request_url"]
    return (
        documents.groupBy("request_url")
        .agg(F.max_by(F.struct(*others), order).alias("d"))
        .select("request_url", "d.*")
    )


def attach_documents(candidates, documents, columns=None):
    """Candidates with the document of their notification link, blank where there is none.

    `documents` has one row per `request_url`.  Candidates without a link match nothing;
    they get scattered keys instead of one NULL key, which would put them all in one task.
    Links that many candidates share are left to the skew split of adaptive execution, which
    splits only a shuffle made for the join itself: the second key column keeps the planner
    from reusing the partitions of the aggregate that made `documents` unique.
    """
    columns = columns or [c for c in documents.columns if c != "request_url"]
    right = documents.select(
        F.col("request_url").alias("_key"), F.xxhash64("request_url").alias("_hash"),
        F.struct(*columns).alias("document"),
    )
    scattered = F.concat(
        F.lit("\n"), F.pmod(F.xxhash64("_seq"), F.lit(_BLANK_KEYS)).cast("string")
    )
    left = candidates.withColumn("_key", F.coalesce(nz(F.col("notification_url")), scattered))
    left = left.withColumn("_hash", F.xxhash64("_key"))
    joined = left.join(right, ["_key", "_hash"], "left").drop("_key", "_hash")
    return joined.withColumn("document", filled(columns))


def filled(columns):
    """The joined struct `document` with blanks where there is none."""
    # a candidate without a usable document gets blank text, hash and file
    plain = {"text": "", "document_hash": "", "source_document": "", "has_text": False}
    return F.struct(
        *[
            (
                F.coalesce(F.col(f"document.{c}"), F.lit(plain[c]))
                if c in plain
                else F.col(f"document.{c}")
            ).alias(c)
            for c in columns
        ]
    )


def attach_landing(candidates, documents, wait):
    """As `attach_documents` for two streams: documents may land before or after their page.

    Both sides have an event time (`fetched_at`) with a watermark, and a document counts if it was fetched
    within `wait` of the page, so state older than that goes.  A candidate whose document doesn't come
    is given out blank once the watermark has passed `wait`; one without a link waits for nothing.  If
    several fetches count, each gives a row.  Adds `_landed`, when page and document were both there.
    """
    columns = [c for c in documents.columns if c not in ("request_url", "fetched_at")]
    right = documents.select(
        F.col("request_url").alias("_key"), F.col("fetched_at").alias("_fetched"), F.struct(*columns).alias("document")
    )
    link, span = nz(F.col("notification_url")), F.expr(f"interval {wait}")
    near = F.col("_fetched").between(F.col("fetched_at") - span, F.col("fetched_at") + span)
    waiting = candidates.filter(link.isNotNull()).join(right, (F.col("notification_url") == F.col("_key")) & near, "left_outer")
    nothing = F.lit(None).cast(right.schema["document"].dataType)
    alone = candidates.filter(link.isNull()).withColumns({"document": nothing, "_fetched": F.lit(None).cast("timestamp")})
    both = waiting.drop("_key").unionByName(alone)
    landed = F.greatest("fetched_at", "_fetched").alias("_landed")
    return both.select(*candidates.columns, landed, filled(columns).alias("document"))


def has_notification(candidates):
    return candidates.filter(non_blank(F.col("notification_url")))


def document_manifest(documents, seq="_seq"):
    """(file_name, final_url, document_hash): of documents with one file name the last stays."""
    return (
        documents.select(
            safe_file_name(F.col("final_url")).alias("file_name"), "final_url", "document_hash", seq
        )
        .groupBy("file_name")
        .agg(F.max_by(F.struct("final_url", "document_hash"), seq).alias("d"))
        .select("file_name", "d.final_url", "d.document_hash")
    )


def file_hashes(blobs):
    """(file_name, n_bytes, document_hash) of landed files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return blobs.select(name.alias("file_name"), F.col("length").alias("n_bytes"), content_hash(F.col("content")).alias("document_hash"))


def check_files(manifest, blobs):
    """(file_name, status) of every manifest row: `same`, `changed` or, where no file landed, `missing`."""
    return check_hashes(manifest, file_hashes(blobs))


def check_hashes(manifest, hashes):
    """`check_files` by the `file_hashes` of the landed files, so that files are read once for both."""
    found = hashes.select("file_name", F.col("document_hash").alias("_found"), F.lit(True).alias("_landed"))
    status = (
        F.when(F.col("_landed").isNull(), "missing")
        .when(F.col("_found").eqNullSafe(F.col("document_hash")), "same")
        .otherwise("changed")
    )
    return manifest.join(found, "file_name", "left").select("file_name", status.alias("status"))
