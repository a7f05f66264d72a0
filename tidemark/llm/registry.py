"""The registered queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.divergence import OP12_SQL, op12_source_divergence
from tidemark.llm.extraction import op11_html_extraction
from tidemark.llm.jaccard import op10_jaccard_join
from tidemark.llm.mixing import op8_mix_sources
from tidemark.llm.mtree import OP9_SQL, op9_exact_topk
from tidemark.llm.phrases import OP13_SQL, op13_phrase_collocations
from tidemark.llm.pieces import op2_sentencepiece
from tidemark.llm.quality import op7_quality_rules
from tidemark.llm.substrings import op4_substring_dedup
from tidemark.llm.suffixes import op5_suffix_dedup
from tidemark.llm.tokenfiles import op3_token_files
from tidemark.llm.urlrank import op1_url_filters
from tidemark.llm.warc import op6_warc_archive

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_sentencepiece, op3_token_files, op4_substring_dedup, op5_suffix_dedup, op6_warc_archive, op7_quality_rules, op8_mix_sources, op9_exact_topk, op10_jaccard_join, op11_html_extraction, op12_source_divergence, op13_phrase_collocations)} | {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {"op9_exact_topk": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_phrase_collocations": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
