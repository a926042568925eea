"""Sources of the document engine: Markdown, HTML, container files."""
