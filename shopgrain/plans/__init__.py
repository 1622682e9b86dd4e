"""The analyses. Every public function returns a lazy DataFrame."""
