"""noticeflow: landed pages and documents to a verified, deduplicated notice table."""
