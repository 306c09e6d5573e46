"""Schemas of the engine's tables."""

BLOCK = "document_id string, seq int, text string, page int, kind string, level int"
CHUNK = "run_id string, document_id string, ordinal int, text string, page int, end_page int, kinds array<string>, section_path string, scheme string, doc_kind string"
RUN = "run_id string, config_hash string, converter string, splitter string, cleaning string, metadata string, started timestamp"
QUESTION = "id string, question string, gold_answer string, gold_pages array<struct<document_id:string,page:int>>, difficulty_tag string, language_tag string, question_type string, annotator_ids array<string>, note string"
MANIFEST = "id string, scheme string, kind string, language string, url string, publisher string, published string, retrieved string, pages int, has_text_layer boolean, text_page_ratio double, sha256 string, bytes bigint, status string"
ANNOTATION = "question_id string, mine string, theirs string, why string, model string, dated string"
GOLD_PAGE = "document_id string, page int, scheme string, language string, has_table boolean, path string, sha256 string, transcribed string"
CANDIDATE = "scheme string, status string, bytes bigint, url string"

#: Block kinds.
HEADING_KINDS = ("SectionHeaderItem", "TitleItem")
TABLE_KINDS = ("TableItem",)
#: The axes of a pipeline configuration.
CONVERTERS = ("pypdf", "docling", "docling-noocr", "docling-routed", "marker", "mineru")
CLEANINGS = ("none", "strip")
SPLITTERS = ("fixed", "section")
METADATA = ("none", "enriched")
#: Question vocabularies.
QUESTION_TYPES = ("factual", "exclusion", "eligibility_multihop", "procedural", "table_lookup", "unanswerable")
LANGUAGES = ("en", "hi", "hinglish")
DIFFICULTIES = ("easy", "medium", "hard")
