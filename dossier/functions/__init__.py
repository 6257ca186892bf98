"""Part of dossier; see the README for the layout."""
