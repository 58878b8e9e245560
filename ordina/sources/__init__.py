"""Readers and writers."""

from .readers import (  # noqa: F401
    catalogue,
    evaluation_sets,
    json_lines,
    kern_records,
    name_list,
    pack,
    raw_pages,
    sample_kinds,
    score_documents,
    svg_systems,
    system_ranges,
    vocabulary_file,
    xml_systems,
)
from .writers import merge_results, write_append_new, write_documents, write_pack, write_pieces, write_summary  # noqa: F401
