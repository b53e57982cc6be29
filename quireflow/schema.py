"""The tables of a library, with declared types; nothing is inferred from data."""

from __future__ import annotations

META = "struct<title: string, authors: array<string>, publisher: string, date: string, language: string, isbn: string, isbn13: string, description: string, subjects: array<string>, producer: string, creator: string, page_count: int>"
FILES = "path string, file_name string, ext string, length bigint, file_hash string, book_id string"
BOOKS = f"book_id string, title string, document_type string, page_count int, word_count bigint, raw_text string, meta {META}, status string, error string"
CHAPTERS = "book_id string, number int, title string, start_page int, end_page int, content string, word_count bigint"
IMAGES = "book_id string, ord int, filename string, content_type string, width int, height int, page_number int, base64_data string"
TOC = "book_id string, seq int, level int, title string, href string, page int, parent_seq int"
PAGES = "book_id string, page int, text string"
IMAGE_DESCRIPTIONS = "book_id string, filename string, description string, ocr_text string, image_type string, width int, height int, page_number int"
CHUNKS = "book_id string, chunk_index int, content string, token_count bigint, chapter_title string, chapter_number int, start_page int, end_page int, source_type string, local_index int, total_chunks int, total_document_chunks int"
POINTS = f"{CHUNKS}, embedding array<float>, is_metadata boolean, title string, authors array<string>, genres array<string>, tags array<string>, difficulty_level string, target_audience string, summary string, main_topics array<string>"
CHECKOUTS = "book_id string, user_id string, checkout_time timestamp_ntz, expiry_time timestamp_ntz, status string, return_time timestamp_ntz, source string"
PROGRESS = "path string, status string, error string, at timestamp_ntz"
#: The stages a book goes through, and the kinds of documents.
STATUSES = ("pending", "extracting", "analyzing", "chunking", "embedding", "storing", "completed", "failed")
DOCUMENT_TYPES = ("epub", "pdf")
#: Payload fields that filters support.
KEYWORD_FIELDS = ("book_id", "authors", "genres", "tags", "difficulty_level")
TEXT_FIELDS = ("title", "chapter_title")
