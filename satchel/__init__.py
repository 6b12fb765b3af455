"""satchel: archives of file trees and byte tables, as DataFrame programs."""
