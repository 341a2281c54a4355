"""Files in, typed block tables out: a document-structuring engine of DataFrame transforms."""
