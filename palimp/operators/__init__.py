"""DataFrame operators over document, page, surface and asset relations."""
