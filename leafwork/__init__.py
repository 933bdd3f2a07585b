"""leafwork: document-geometry analytics as DataFrame operators."""
