"""Sources: topics, mailboxes, message files, labelled texts, output logs."""
