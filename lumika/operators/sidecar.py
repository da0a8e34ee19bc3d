"""XMP sidecars: what goes into them, the packet's text, and the files."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumika.operators.aesthetic import rating

LEAST_SCORE = 0.5
# The namespaces of an XMP packet.
SPACES = {
    "x": "adobe:ns:meta/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/",
}
PACKET_ID = "W5M0MpCehiHzreSzNTczkc9d"


def sidecar_tags(manual: DataFrame, auto: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(photo_id, tags): manual tags by name, then automatic ones by falling score; of tags alike but for case the first stays.

    `manual(photo_id, name)`, `auto(photo_id, label, score)`.
    """
    hand = manual.select("photo_id", F.col("name").alias("tag"), F.lit(0).alias("side"), F.lit(0.0).alias("rank"))
    made = auto.where(F.col("score") >= least).select("photo_id", F.col("label").alias("tag"), F.lit(1).alias("side"), (-F.col("score")).alias("rank"))
    both = hand.unionByName(made).where("tag is not null")
    first = both.groupBy("photo_id", F.lower("tag").alias("fold")).agg(F.min(F.struct("side", "rank", "tag")).alias("t"))
    return first.groupBy("photo_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"]).alias("tags"))


def manual_tags(photo_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """(photo_id, name): the manual tags of each photo, each once; links to tags that are gone are left out."""
    names = tag.where("id is not null and name is not null").select(F.col("id").alias("tag_id"), "name")
    return photo_tag.where("photo_id is not null").select("photo_id", "tag_id").join(names, "tag_id").select("photo_id", "name").distinct()


def members_of(collection_photo: DataFrame, collection_id: int) -> DataFrame:
    """(photo_id): the photos that were put into a collection by hand."""
    return collection_photo.where((F.col("collection_id") == collection_id) & F.col("photo_id").isNotNull()).select("photo_id").distinct()


def sidecar_persons(faces: DataFrame, person: DataFrame) -> DataFrame:
    """(photo_id, persons): the names on each photo, each once, in order."""
    named = faces.join(person.select(F.col("id").alias("person_id"), "name"), "person_id").select("photo_id", "name").distinct()
    return named.groupBy("photo_id").agg(F.array_sort(F.collect_list("name")).alias("persons"))


def export_selection(photo: DataFrame, ids: list[int] | None = None, prefix: str | None = None, members: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The photos to export in order of id: those of all given selections; an empty list of ids selects nothing."""
    rows = photo
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids) if ids else F.lit(False))
    if members is not None:
        rows = rows.join(members.select("photo_id").distinct(), rows["id"] == F.col("photo_id"), "left_semi")
    if prefix:
        rows = rows.where(F.col("path").startswith(prefix.rstrip("/") + "/"))
    rows = rows.orderBy("id")
    return rows.limit(limit) if limit else rows


def chosen_for_export(photo: DataFrame, ids: list[int] | None = None, prefix: str | None = None, members: DataFrame | None = None, everything: bool = False, limit: int | None = None) -> DataFrame:
    """`export_selection`, but without any selector only if `everything` is asked for by name; an empty list of ids is none."""
    if not ids and not prefix and members is None and not everything:
        raise ValueError("no selector: give ids, a path prefix, a collection, or ask for everything")
    return export_selection(photo, ids or None, prefix, members, limit)


def _escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _bag(items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda t: F.concat(F.lit("<rdf:li>"), _escape(t), F.lit("</rdf:li>"))), "")
    return F.concat(F.lit("<rdf:Bag>"), lines, F.lit("</rdf:Bag>"))


def packet(tags: Column, caption: Column, stars: Column, persons: Column, created: Column) -> Column:
    """The packet as text; a part without content is left out."""
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in SPACES.items())
    wrap = lambda there, *parts: F.when(there, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise(F.lit(""))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat(
        F.lit(f'<?xpacket begin="﻿" id="{PACKET_ID}"?>\n<x:xmpmeta {spaces}><rdf:RDF><rdf:Description rdf:about="">'),
        wrap(some(tags), "<dc:subject>", _bag(tags), "</dc:subject>"),
        wrap(full(caption), '<dc:description><rdf:Alt><rdf:li xml:lang="x-default">', _escape(caption), "</rdf:li></rdf:Alt></dc:description>"),
        wrap(stars.isNotNull(), "<xmp:Rating>", stars.cast("string"), "</xmp:Rating>"),
        wrap(some(persons), "<Iptc4xmpExt:PersonInImage>", _bag(persons), "</Iptc4xmpExt:PersonInImage>"),
        wrap(full(created), "<photoshop:DateCreated>", _escape(created), "</photoshop:DateCreated>"),
        F.lit('</rdf:Description></rdf:RDF></x:xmpmeta>\n<?xpacket end="w"?>\n'),
    )


def target_path(path: Column) -> Column:
    """Relative path of a photo's sidecar: the photo's own with its extension replaced, without the leading slash."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"(?<=[^/])\.[^./]*$", ""), F.lit(".xmp"))


def sidecars(selection: DataFrame, tags: DataFrame, persons: DataFrame) -> DataFrame:
    """(photo_id, target, packet): one sidecar for each target; where photos share one, that of the largest id."""
    rows = selection.select(F.col("id").alias("photo_id"), "path", "caption", "aesthetic", "captured_at").join(tags, "photo_id", "left").join(persons, "photo_id", "left")
    text = packet(F.col("tags"), F.col("caption"), rating(F.col("aesthetic")), F.col("persons"), F.col("captured_at"))
    made = rows.select("photo_id", target_path(F.col("path")).alias("target"), text.alias("packet"))
    return made.groupBy("target").agg(F.max(F.struct("photo_id", "packet")).alias("m")).select("m.photo_id", "target", "m.packet")


def write_sidecars(made: DataFrame, out_dir: str) -> DataFrame:
    """Write the sidecars below a folder all executors share: (written, skipped, failed, total).

    A target that leaves the folder fails; an existing file that is no sidecar of ours is skipped, never overwritten.
    Files are private to their owner.
    """
    if not out_dir.startswith("/"):
        raise ValueError("the folder must be an absolute path")

    def write(batches):
        import os

        import pandas as pd

        root = Path(out_dir).resolve()
        for batch in batches:
            states = []
            for target, text in zip(batch["target"], batch["packet"]):
                path = (root / str(PurePosixPath(target))).resolve()
                if not path.is_relative_to(root):
                    states.append("failed")
                    continue
                if path.exists() and PACKET_ID not in path.read_text(encoding="utf-8", errors="replace"):
                    states.append("skipped")
                    continue
                path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
                part = path.with_suffix(f".{os.getpid()}.part")
                part.write_text(text, encoding="utf-8")
                part.chmod(0o600)
                part.replace(path)
                states.append("written")
            yield pd.DataFrame({"state": states})

    states = made.select("target", "packet").mapInPandas(write, "state string")
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("written", "skipped", "failed")], F.count("*").alias("total"))
