"""quillstack: a document-stack analytics engine written against the Spark DataFrame API."""
