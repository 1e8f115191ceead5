"""Schemas of the working tables and of the page artifact."""

from __future__ import annotations

#: One row per revision; idx counts from 0 within its page, oldest first.
REVISIONS = "page_id long, idx int, revid long, ts timestamp, text string, size long"

META = (
    "struct<title:string,count:int,partitions:array<array<int>>,revids:array<long>,timestamps:array<string>,base_texts:map<string,string>,"
    "orig_size:long,space_cost:long,time_cost:long,sizes:array<int>,solver:string,strategy:string,time_budget:long,page_id:long,chain_lengths:array<int>>"
)
#: One gzip-compressed JSON document per page; patch keys are "from-to".
ARTIFACT = f"title string, anchors array<int>, patches map<string,array<string>>, base_texts map<string,string>, meta {META}"

METRICS = (
    "artifact string, title string, page_id long, n_revisions int, n_anchors int, n_partitions int, avg_chain_len double, max_chain_len int, "
    "space_cost long, time_cost long, orig_size long, compression_ratio double, anchor_density double, solver string, strategy string, time_budget long"
)
MANIFEST = (
    "title string, page_id long, source_file string, artifact string, revisions int, anchors int, partitions int, solver string, strategy string, "
    "time_budget long, compress_seconds double, space_cost long, time_cost long"
)
#: What a manifest without rows has as its header.
MANIFEST_LEAST = ("title", "page_id", "source_file", "artifact", "error")
